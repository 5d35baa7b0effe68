"""Personal data: checked patterns, and a linear-chain conditional random field over word shapes, decoded by Viterbi."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import buffers, slices

# Fixed values of the contract: kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
#: Words on each side of one with a digit or an @ that belong to its sequence.
CONTEXT = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        v = ord(ch) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The email pattern's leftmost matches, in time linear in the text: each @ is tried once, from both sides."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the checked patterns, in order of start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split(".")))]
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out)


def shape(word: str) -> str:
    """Runs of letters as a or A, of digits as 9 and their capped length, other characters as they are."""
    s = re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)};", re.sub(r"[^\W\d_]+", lambda m: "A" if m.group().isupper() else "a", word))
    return s


def _core(word: str) -> tuple[int, int]:
    """Where a word begins and ends without the punctuation around it; a leading + or bracket of a number stays."""
    a, b = 0, len(word)
    while a < b and not (word[a].isalnum() or (word[a] in "+(" and any(c.isdigit() for c in word[a + 1 : a + 3]))):
        a += 1
    while b > a and not (word[b - 1].isalnum() or (word[b - 1] == ")" and "(" in word[a:b])):
        b -= 1
    return a, b


def features(words: list[str]) -> list[list[str]]:
    """Shape features of each word of a sequence, with its neighbours' shapes."""
    cores = [w[a:b] for w in words for a, b in [_core(w)]]
    shapes = [shape(c) for c in cores]
    out = []
    for i, (c, s) in enumerate(zip(cores, shapes)):
        digits = re.sub(r"[^0-9]", "", c)
        f = ["bias", "s=" + s, f"d={min(len(digits), 20)}", "c=" + re.sub(r"\d+;", "", s)]
        if "@" in c:
            f.append("at")
        if digits and not re.search(r"[^0-9 -]", c):
            f.append("luhn" if 12 <= len(digits) <= 19 and luhn(digits) else "not luhn")
        if c.count(".") == 3 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in c.split(".")):
            f.append("quad")
        f.append("p=" + (shapes[i - 1] if i else "<"))
        f.append("n=" + (shapes[i + 1] if i + 1 < len(words) else ">"))
        out.append(f)
    return out


def labelled_table(seed: int = 3, rows: int = 360) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: word sequences with a label for each word, written from forms by a seeded rule.

    Positive forms are addresses, quads, card numbers with a right check digit, and phone numbers with or
    without a country code. Versions, dates, prices, hex strings, wrong check digits and handles are none.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(int(x)) for x in rng.integers(0, 10, n))
    syllables = ["ra", "the", "on", "ver", "li", "ment", "os", "ch", "un", "ed", "in", "a"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))

    def card(n: int, right: bool) -> str:
        while True:
            d = digits(n)
            if luhn(d) == right and d[0] != "0":
                return d

    def entity(k: int) -> tuple[list[str], str | None]:
        if k == 0:
            return [f"{word()}{pick(['', '.', '_'])}{pick(['', digits(2)])}@{word()}{pick(['', digits(1)])}.{pick(['com', 'example.com', 'org', 'de'])}"], "email"
        if k == 1:
            return [".".join(str(int(x)) for x in rng.integers(1, 256, 4))], "ip"
        if k == 2:
            d = card(16, True)
            return pick([[d], [d[:4], d[4:8], d[8:12], d[12:]], ["-".join([d[:4], d[4:8], d[8:12], d[12:]])]]), "card"
        if k in (3, 4):
            a, b, c = digits(3), digits(3), digits(4)
            return pick([["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"+49", a, b + c], [f"{a}-{b}-{c}"], [f"+{digits(11)}"]]), "phone"
        return pick([
            [digits(int(rng.integers(1, 6)))], [f"{digits(1)}.{digits(1)}."], [f"{digits(2)}:{digits(2)}"], [f"20{digits(2)}-0{digits(1)}-1{digits(1)}"],
            [digits(9)], [card(16, False)], ['"' + "".join(pick("0123456789abcdef") for _ in range(40)) + '"'], [f"v{digits(1)}.{digits(1)}.{digits(1)}"],
            [f"${digits(2)}.{digits(2)}"], [f"@{word()}"], [f"{digits(4)}.{digits(3)}.{digits(3)}.{digits(1)}"], [f"{digits(3)}-{digits(2)}"], [f"CC{digits(1)}-{word()}"], [digits(7)],
            [card(15, False)], [word() + digits(3)], [f"({digits(2)})"], [f"{digits(4)}", f"{digits(4)}"],
        ]), None

    table = []
    for r in range(rows):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 3))):
            n = int(rng.integers(0, 4))
            words += [pick([word(), word().capitalize(), word() + pick([".", ","]), word().upper() + "!!"]) for _ in range(n)]
            labels += ["O"] * n
            parts, kind = entity(r % 8)
            if rng.random() < 0.3:
                parts = [*parts[:-1], parts[-1] + pick([".", ",", "###", "%%%", "!!", "$$$"])]
            words += parts
            labels += ["O"] * len(parts) if kind is None else [f"{'B' if i == 0 else 'I'}-{kind}" for i in range(len(parts))]
        n = int(rng.integers(0, 4))
        words += [word() for _ in range(n)]
        labels += ["O"] * n
        table.append((words, labels))
    return table


@dataclass
class Crf:
    """Weights of features for labels and of label pairs; transitions into I-k come only from B-k and I-k."""

    index: dict[str, int]
    emit: np.ndarray
    step: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for lo in range(0, len(words), 4096):  # with a neighbour on each side, which is as far as features look
            first = max(0, lo - 1)
            for i, f in enumerate(features(words[first : lo + 4097])[lo - first :][:4096], lo):
                rows = [self.index[x] for x in f if x in self.index]
                if rows:
                    out[i] = self.emit[rows].sum(axis=0)
        return out


def _allowed() -> np.ndarray:
    barred = np.zeros((len(LABELS) + 1, len(LABELS)))  # the last row is the start
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate((*LABELS, "start")):
                if a[1:] != b[1:]:
                    barred[i, j] = -1e4
    return barred


def train_crf(table: list[tuple[list[str], list[str]]], epochs: int = 8, rate: float = 0.3, seed: int = 7) -> Crf:
    """Stochastic gradient ascent on the conditional likelihood, by forward and backward sums."""
    index: dict[str, int] = {}
    rows = []
    for words, labels in table:
        f = [[index.setdefault(x, len(index)) for x in fs] for fs in features(words)]
        rows.append((f, [LABELS.index(y) for y in labels]))
    n = len(LABELS)
    emit, step, barred = np.zeros((len(index), n)), np.zeros((n + 1, n)), _allowed()
    order = np.random.default_rng(seed)
    for epoch in range(epochs):
        lr = rate / (1 + epoch)
        for r in order.permutation(len(rows)):
            f, y = rows[r]
            e = np.stack([emit[x].sum(axis=0) for x in f])
            t = step + barred
            m = len(y)
            alpha, beta = np.zeros((m, n)), np.zeros((m, n))
            alpha[0] = t[n] + e[0]
            for i in range(1, m):
                z = alpha[i - 1][:, None] + t[:n]
                top = z.max(axis=0)
                alpha[i] = top + np.log(np.exp(z - top).sum(axis=0)) + e[i]
            for i in range(m - 2, -1, -1):
                z = t[:n] + (e[i + 1] + beta[i + 1])[None, :]
                top = z.max(axis=1)
                beta[i] = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
            whole = alpha[-1].max() + np.log(np.exp(alpha[-1] - alpha[-1].max()).sum())
            node = np.exp(alpha + beta - whole)
            for i in range(m):
                g = -node[i]
                g[y[i]] += 1
                np.add.at(emit, f[i], lr * g)
                if i:
                    pair = np.exp(alpha[i - 1][:, None] + t[:n] + (e[i] + beta[i])[None, :] - whole)
                    step[:n] -= lr * pair
                    step[y[i - 1], y[i]] += lr
                else:
                    step[n] -= lr * node[0]
                    step[n, y[0]] += lr
        emit *= 0.995
    return Crf(index, emit, step + barred)


def viterbi(model: Crf, sequences: list[list[str]]) -> list[np.ndarray]:
    """Best labels of many sequences at once, padded to the longest."""
    if not sequences:
        return []
    n, longest = len(LABELS), max(map(len, sequences))
    e = np.zeros((len(sequences), longest, n))
    for k, words in enumerate(sequences):
        e[k, : len(words)] = model.scores(words)
    length = np.array([len(s) for s in sequences])
    best = model.step[n][None, :] + e[:, 0]
    back = np.zeros((len(sequences), longest, n), dtype=np.int8)
    for i in range(1, longest):
        z = best[:, :, None] + model.step[None, :n]
        back[:, i] = z.argmax(axis=1)
        best = np.where((i < length)[:, None], z.max(axis=1) + e[:, i], best)
    last = best.argmax(axis=1)
    out = []
    for k, m in enumerate(length.tolist()):
        y = np.empty(m, dtype=np.int64)
        y[-1] = last[k]
        for i in range(m - 1, 0, -1):
            y[i - 1] = back[k, i, y[i]]
        out.append(y)
    return out


def _sequences(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words near a word with a digit or an @; only there can the model find anything."""
    spans = [m.span() for m in _WORD.finditer(text)]
    marked = [i for i, (a, b) in enumerate(spans) if re.search(r"[0-9@]", text[a:b])]
    out: list[list[tuple[int, int]]] = []
    end = -1
    for i in marked:
        a, b = max(0, i - CONTEXT), min(len(spans), i + CONTEXT + 1)
        if a < end:
            out[-1] += spans[end:b]
        else:
            out.append(spans[a:b])
        end = max(end, b)
    return out


def model_spans(texts: list[str], model: Crf) -> list[list[tuple[int, int, int]]]:
    """For each text the (start, kind index, end) of what the random field finds on its own."""
    runs, owner = [], []
    for k, t in enumerate(texts):
        for s in _sequences(t):
            runs.append(s)
            owner.append(k)
    more: dict[int, list] = {}
    order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
    lo = 0
    while lo < len(order):
        # whole runs, so that no entity is split; the longer they are, the fewer share a padded batch
        some = [i for j, i in enumerate(order[lo : lo + 512], 1) if j == 1 or j * len(runs[i]) <= 512 * 256]
        lo += len(some)
        for i, y in zip(some, viterbi(model, [[texts[owner[i]][a:b] for a, b in runs[i]] for i in some])):
            text, spans, j = texts[owner[i]], runs[i], 0
            while j < len(y):
                if y[j] == 0:
                    j += 1
                    continue
                kind, first = (int(y[j]) - 1) // 2, j
                j += 1
                while j < len(y) and y[j] == 2 * kind + 2:
                    j += 1
                (a, _), (c, d) = spans[first], spans[j - 1]
                start, stop = a + _core(text[a : spans[first][1]])[0], c + _core(text[c:d])[1]
                if start < stop:
                    more.setdefault(owner[i], []).append((start, kind, stop))
    return [more.get(k, []) for k in range(len(texts))]


def found_spans(texts: list[str], model: Crf) -> list[tuple[list, list]]:
    """For each text the base spans, and all spans: the base ones and those of the model that overlap none of them."""
    out = []
    for t, own in zip(texts, model_spans(texts, model)):
        base = base_spans(t)
        extra = [x for x in own if not any(x[0] < b[2] and b[0] < x[2] for b in base)]
        out.append((base, sorted(base + extra)))
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _rows(batches: Iterator[pa.RecordBatch], model: Crf) -> Iterator[pa.RecordBatch]:
    marks = np.zeros(256, dtype=bool)
    marks[[*range(48, 58), 64]] = True
    for batch in batches:
        for part in slices(batch, "text"):
            buf, off = buffers(part.column("text"))
            hits = np.concatenate([[0], np.cumsum(marks[buf])])
            some = np.flatnonzero(hits[off[1:]] > hits[off[:-1]])  # the other texts can hold no span
            texts = part.column("text").take(pa.array(some)).to_pylist()
            base, every = [[]] * part.num_rows, [[]] * part.num_rows
            for i, (b, e) in zip(some.tolist(), found_spans(texts, model)):
                base[i], every[i] = b, e
            kept = {c: part.column(c) for c in part.schema.names if c != "text"}
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            yield pa.record_batch([
                *kept.values(), *counts, pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b in base]),
                pa.array([_written(e) for e in every]), pa.array([len(e) for e in every], pa.int64()),
            ], names=[*kept, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list | None = None) -> DataFrame:
    """Spans of personal data in every whole text: ``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans``.

    The counts by kind and ``base_sha256`` are of the checked patterns; ``spans``, and their number, has these and what the
    random field adds where no base span lies. The field learns from the small ``table`` on the driver, and goes to executors as weights.
    It decodes whole runs of words near digits or an @, however long, in padded numpy batches.

    Null and empty texts have no spans, counts of 0 and the hash of the empty string; very long texts are searched whole, one
    being the least a task holds; repeated rows are searched each; an empty table gives no rows; other columns of ``docs`` are not
    read, whatever their names; offsets are code points, ends exclusive.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_crf(table or labelled_table()))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long"
    return rows.mapInArrow(lambda it: _rows(it, model.value), schema)
