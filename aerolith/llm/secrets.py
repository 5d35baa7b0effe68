"""Secrets: checked patterns, and a lexer of assignments that propagates constants and scores literals by the names they reach."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import slices

# Fixed values of the contract: kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18

#: Words of a name that make its value sensitive, and how much so.
SENSITIVE = {
    "password": 3, "passwords": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "passcode": 3, "secret": 3, "secrets": 3, "token": 3, "apikey": 3, "credential": 3,
    "credentials": 3, "accesskey": 3, "privatekey": 3, "secretkey": 3, "authtoken": 3, "pass": 2, "jwt": 2, "bearer": 2, "authorization": 2, "salt": 2, "hmac": 2,
}
#: Words that make "key" after them sensitive.
KEYS = frozenset("api access private secret encryption signing master shared account storage client auth session deploy service license".split())
#: Last words of names whose values tell of a secret without being one.
ABOUT = frozenset("""name id file path url uri dir type field label hint prompt placeholder policy reset regex pattern format header length len count max min limit
expiry expires ttl timeout algorithm issuer endpoint env var param column prefix suffix version enabled required valid error message title hash""".split())
#: First words of functions that store what they are given, and functions that give back what they are given.
STORING, WRAPPING = frozenset(("set", "with", "use")), frozenset("str String bytes SecretStr Buffer.from new_string encode b64decode atob".split())
_PREFIX = frozenset("b r f u rb br fr rf B R F U L N".split())
_PLACEHOLDER = re.compile(r"example|change_?me|your|placeholder|x{4}|\*{3}|\.{3}|dummy|redacted|todo|insert|sample|[<>]|\$\{|\{\{|%\(|\$\(", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_INSIDE = re.compile(r"\$\{([A-Za-z_]\w*)\}|\{([A-Za-z_]\w*)\}|%\(([A-Za-z_]\w*)\)s|\$([A-Za-z_]\w*)")
_BRACED = re.compile(r"\$?\{[A-Za-z_]\w*\}|%\([A-Za-z_]\w*\)s")
_TOKEN = re.compile(
    r"(?P<name>[A-Za-z_$@][\w$]*+(?:(?:\.|->|::|\?\.|-)[A-Za-z_$][\w$]*+)*+)|(?P<op>===?|!==?|<=|>=|=>|:=|::|\+=|\?\?|\|\||[=:+.()\[\]{},;])|(?P<quote>[\"'`])|(?P<line>\n)|(?P<other>[^\s\w])"
    r"|(?P<number>\d[\w]*+)", re.A)
_CLOSE = {q: re.compile(rf"(?:[^{q}\\\n]|\\[^\n])*+{q}") for q in "\"'`"}
_BARE = re.compile(r"[ \t]*+([^\s\"'`,;#(){}\[\]<>]++)[ \t]*+(?=[#;\n]|\Z)")
_BEFORE = re.compile(r"[ \t]*+(?:-[ \t]++)?(?:(?:export|set|env|const|let|var)[ \t]++)?", re.I)
#: Least sum of a name's and a literal's scores, and least score of the name.
THRESHOLD, LEAST_NAME = 5.0, 2.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the checked patterns, in order of start, then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= LEAST_VALUE] if "=" in text or ":" in text else []
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    """How sensitive a variable, key or parameter of this name is: 0 to 3."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0.0
    best = max(SENSITIVE.get(w, 0) for w in words)
    if any(b in ("key", "keys") and a in KEYS for a, b in zip(words, words[1:])):
        best = 3
    return 0.0 if "public" in words else float(best)


def literal_score(text: str, quoted: bool) -> float:
    """How much a literal looks like a secret rather than a word, a path, a sentence or a stand-in."""
    text = _BRACED.sub("", text)
    n = len(text)
    if n < 6 or _PLACEHOLDER.search(text) or len(set(text)) < 4:
        return 0.0
    letters, digits = sum(c.isalpha() for c in text), sum(c.isdigit() for c in text)
    other = n - letters - digits
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(text).values())
    score = 0.5 * quoted + (n >= 8) + (n >= 16) + (entropy >= 3.0) + (letters > 0 and digits > 0) + (other > 0 and letters + digits > 0 and not text.replace("_", "a").replace("-", "a").isalnum())
    if any(c.isspace() for c in text):
        score -= 3
    if re.match(r"(?:[a-z]+://[^:@/\s]*+(?:/|\Z)|\.{0,2}/|[A-Za-z]:\\)", text) or re.fullmatch(r"[A-Za-z_]+(?:[./:][A-Za-z_]+)+", text):
        score -= 3
    if not digits and re.fullmatch(r"[A-Za-z]?[a-z]*(?:[-_ ]?[A-Za-z]?[a-z]+)*|[A-Z]+(?:_[A-Z]+)*", text):
        score -= 2
    if not quoted and re.fullmatch(r"[A-Za-z_]\w*", text) and digits < 2:
        score -= 2
    return score


@dataclass(slots=True)
class Pair:
    """A name with what it is given: literals (start, stop, quoted) and names of constants."""

    name: str
    literals: list = field(default_factory=list)
    refs: list = field(default_factory=list)


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the lines that hold an assignment sign or a storing call; strings without their quotes. Linear in the text.

    A quote opens a string where no word ends before it and the same line has its end; else it is punctuation, and so are the line's later ones.
    """
    out: list[tuple[str, int, int]] = []
    lo, n = 0, len(text)
    while lo < n:
        hi = text.find("\n", lo)
        hi = n if hi < 0 else hi
        if text.find("=", lo, hi) < 0 and text.find(":", lo, hi) < 0 and text.find("(", lo, hi) < 0 and not (out and text[lo:hi].lstrip()[:1] in ("'", '"')):
            if out and out[-1][0] != "gap":
                out.append(("gap", lo, lo))
            lo = hi + 1
            continue
        at, dead = lo, set()
        while at < hi:
            m = _TOKEN.search(text, at, hi)
            if not m:
                break
            kind, a, at = m.lastgroup, m.start(), m.end()
            if kind == "quote":
                q = m.group()
                inner = q == "'" and a > lo and text[a - 1].isalnum() and not (text[a - 1] in "bruBRULN" and not text[max(lo, a - 2) : a - 1].isalnum())
                if not inner and q not in dead:
                    end = _CLOSE[q].match(text, at, hi)
                    if end:
                        out.append(("text", at, end.end() - 1))
                        at = end.end()
                        continue
                    dead.add(q)
                kind = "other"
            out.append((kind if kind != "op" else m.group(), a, at))
        out.append(("line", hi, hi))
        lo = hi + 1
    return out


def pairs(text: str) -> list[Pair]:
    """The names that source and configuration syntax gives values to, in order, with literals and constants of each value.

    Read are ``name = value``, ``name: value``, ``"name": value``, ``x["name"] = value``, ``name: type = value``, ``name => value``, keyword
    arguments, ``set_name(value)`` and unquoted values that end a line; a value is literals and constants joined by +, a dot or a default's sign.
    """
    found: list[Pair] = []
    toks = tokens(text)
    word = lambda t: text[t[1] : t[2]]
    kind = lambda k: toks[k][0] if 0 <= k < len(toks) else ""
    first_at, fresh = -1, True  # where a line's own name can begin
    for k, (op, start, stop) in enumerate(toks):
        if fresh and op not in ("line", "gap"):
            first_at = _BEFORE.match(text, text.rfind("\n", 0, start) + 1).end()
        fresh = op in ("line", "gap")
        names: list[str] = []
        if op in ("=", ":", ":=", "=>", "+="):
            if kind(k - 1) in ("name", "text"):
                names.append(word(toks[k - 1]))
                if op == "=" and kind(k - 2) == ":" and kind(k - 3) == "name":
                    names.append(word(toks[k - 3]))
            elif kind(k - 1) == "]" and kind(k - 2) == "text" and kind(k - 3) == "[":
                names.append(word(toks[k - 2]))
            elif kind(k - 1) == "]" and op == "=":
                j = next((j for j in range(k - 2, max(k - 12, -1), -1) if kind(j) == "["), -1)
                if kind(j - 1) == "name" and kind(j - 2) == ":" and kind(j - 3) == "name":
                    names.append(word(toks[j - 3]))
            first = k + 1
        elif op == "name" and kind(k + 1) == "(" and (_WORD.findall(word(toks[k]).rsplit(".", 1)[-1]) or [""])[0].lower() in STORING:
            names, first = [word(toks[k])], k + 2
        if not names:
            continue
        pair = Pair(names[-1])
        bare = _BARE.match(text, stop) if op in ("=", ":") and kind(k - 1) in ("name", "text") and first_at in (toks[k - 1][1], toks[k - 1][1] - 1) else None
        if bare:
            pair.literals.append((bare.start(1), bare.end(1), False))
            pair.refs.append(bare.group(1))
            found.append(pair)
            continue
        _value(text, toks, first, pair)
        for name in names:
            found.append(Pair(name, pair.literals, pair.refs))
    return found


def _value(text: str, toks: list[tuple[str, int, int]], at: int, pair: Pair) -> None:
    """Collect the operands of the value that begins at token ``at``."""
    kind = lambda k: toks[k][0] if k < len(toks) else ""
    depth = 0
    while True:
        while kind(at) in ("(", "[") or (kind(at) == "line" and (depth or kind(at + 1) in ("text", "("))):
            depth += kind(at) != "line"
            at += 1
        if kind(at) == "name":
            name = text[toks[at][1] : toks[at][2]]
            if kind(at + 1) == "text" and name in _PREFIX and toks[at + 1][1] - 1 == toks[at][2]:
                at += 1
                continue
            if kind(at + 1) == "(":
                if name not in WRAPPING:
                    return
                at += 2
                depth += 1
                continue
            if name in ("new", "await", "or", "and"):
                at += 1
                continue
            pair.refs.append(name)
        elif kind(at) == "text":
            a, b = toks[at][1:]
            pair.literals.append((a, b, True))
            pair.refs += [next(filter(None, m.groups())) for m in _INSIDE.finditer(text, a, b)]
        else:
            return
        at += 1
        while kind(at) == ")":
            depth = max(0, depth - 1)
            at += 1
        if kind(at) in ("+", ".", "||", "??"):
            at += 1
        elif kind(at) == "name" and text[toks[at][1] : toks[at][2]] == "or":
            at += 1
        elif not (kind(at) == "text" or (kind(at) == "line" and depth and kind(at + 1) == "text")):
            return


def _plain(name: str) -> str:
    return re.sub(r"^(?:self|this|cls|process\.env|env)\.|^[$@]+", "", name)


def lexed_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, stop, name, score) of the literals that reach a sensitive name, themselves or through constants, in order.

    A constant is the latest definition of its name before the use. Sensitivity goes from a name to the constants in its value, last pair
    first, so chains of any length take one pass.
    """
    if "=" not in text and ":" not in text and "(" not in text:
        return []
    every = pairs(text)
    defined: dict[str, list[int]] = {}
    for k, p in enumerate(every):
        defined.setdefault(_plain(p.name), []).append(k)
    reached = [(name_score(p.name), p.name) for p in every]
    for k in range(len(every) - 1, -1, -1):
        if reached[k][0] >= LEAST_NAME:
            for r in every[k].refs:
                places = defined.get(_plain(r), ())
                j = bisect_left(places, k) - 1 if places else -1
                if j >= 0 and reached[places[j]][0] < reached[k][0]:
                    reached[places[j]] = reached[k]
    best: dict[tuple[int, int], tuple[str, float]] = {}
    for p, (score, name) in zip(every, reached):
        if score >= LEAST_NAME:
            for a, b, quoted in p.literals:
                looks = literal_score(text[a:b], quoted)
                if looks > 0 and score + looks >= THRESHOLD and best.get((a, b), ("", 0.0))[1] < score + looks:
                    best[a, b] = (name, score + looks)
    out: list[tuple[int, int, str, float]] = []
    for (a, b), (name, score) in sorted(best.items()):
        if not out or a >= out[-1][1]:
            out.append((a, b, name, score))
    return out


def found_spans(text: str) -> list[tuple[str, int, int, str | None, float | None]]:
    """(kind, start, stop, name, score) in order: the base spans, without name and score, and lexed literals that overlap none of them."""
    base = base_spans(text)
    out = [(a, k, b, None, None) for a, k, b in base]
    own = lexed_spans(text)
    if own:
        # by start, with the farthest end so far, so that overlap is one look-up
        starts, reach, far = [b[0] for b in base], [], 0
        for b in base:
            far = max(far, b[2])
            reach.append(far)
        for a, b, name, score in own:
            j = bisect_left(starts, b)
            if not j or reach[j - 1] <= a:
                out.append((a, 0, b, name, score))
    return [(KINDS[k], a, b, name, score) for a, k, b, name, score in sorted(out, key=lambda s: s[:3])]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            spans = [[dict(zip(("kind", "start", "stop", "name", "score"), s)) for s in found_spans(t)] if t else [] for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(spans, _SPANS)], names=["_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text: ``id_col`` and ``spans``, an array of ``kind, start, stop, name, score`` in order of start, then kind.

    Spans of the checked patterns (kinds assign, access and hex) have no name and score. The lexer's are of kind assign: a literal, without
    its quotes, the sensitive name that it reaches, and the sum of both scores; they are added where no span of a pattern lies.

    Null and empty texts have no spans; very long texts are searched whole, in time linear in them, one being the least a task holds; repeated
    rows are searched each; an empty table gives no rows; other columns of ``docs`` are not read, whatever their names; offsets are code
    points, ends exclusive. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,stop:long,name:string,score:double>>"
    return rows.mapInArrow(_rows, schema).select(F.col("_id").alias(id_col), "spans")
