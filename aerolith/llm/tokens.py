"""Token counts: batch encoding in Arrow functions, lengths only, batches balanced by bytes, long texts cut safely."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import slices

#: A byte-level pre-token never reaches over a space that a visible character follows: it begins there.
_SAFE = re.compile(r"(?= \S)")
#: A space that white space or the end follows, so that a plain split at spaces would not cut safely.
_UNSAFE_SPACE = re.compile(r" (?=\s|\Z)")
#: Pieces longer than this are cut further: before other white space that a visible character follows (a line's end is a
#: pre-token then), and where a letter or digit ends before another visible character, which always begins a pre-token.
LONG = 1024
_INNER = re.compile(r"(?=[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]\S)|(?<=[^\W_])(?=[^\w\s]|_)")
#: A single space between visible characters other than the mark that sentencepiece has for it and puts before every word, the first included.
_SINGLE = re.compile("(?<=[^\\s\u2581]) (?=[^\\s\u2581])")
#: Most pieces whose lengths a worker remembers; then it starts anew.
_REMEMBERED = 1 << 18
_loaded: dict[str, tuple] = {}


def load(path: str) -> tuple[Callable[[list[str]], list[int]], Callable[[str], list[str]] | None]:
    """The tokenizer of ``path``, once a worker: ``tokenizers`` for .json, ``sentencepiece`` for .model; and how it may cut texts."""
    if path not in _loaded:
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            special = _byte_level(t.to_str())
            _loaded[path] = lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)], special and partial(pieces, special=special)
        elif path.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in p.encode(texts, num_threads=1)], _SINGLE.split if _marks_words(p) else None
        else:
            raise ValueError(f"no library for {path}")
    return _loaded[path]


def _byte_level(spec: str) -> re.Pattern | None:
    """A pattern of the special strings of a tokenizer whose pre-tokens may be cut at; None for any other."""
    spec = json.loads(spec)
    before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in added):
        return None
    return re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")


def _marks_words(p) -> bool:
    """Whether no piece of a sentencepiece model reaches from one word into the next, and the first word is marked like the others."""
    mark = "\u2581"
    names = [p.id_to_piece(k) for k in range(p.get_piece_size())]
    apart = all(mark not in n[1:] or not n.strip(mark) for n in names)
    return apart and p.encode("a a", out_type=str) == 2 * p.encode("a", out_type=str) and p.encode("a", out_type=str)[0].startswith(mark)


class _Lengths(dict):
    """Token counts of pieces; each distinct piece of a batch is encoded once, together with the batch's others."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def learn(self, found: list[list[str]]) -> None:
        if len(self) > _REMEMBERED:
            self.clear()
        new = list(set().union(*found).difference(self))
        self.update(zip(new, self.encode(new)))


def pieces(text: str, special: re.Pattern = re.compile(r"(?!)")) -> list[str]:
    """A text cut at every safe boundary; joined again they are the text. Long pieces that hold a ``special`` string are not cut further."""
    if _UNSAFE_SPACE.search(text):
        found = _SAFE.split(text)
    else:
        head, *rest = text.split(" ")
        found = [head, *map(" ".__add__, rest)]
    if len(text) > LONG and any(len(p) > LONG for p in found):
        found = [q for p in found for q in ([p] if len(p) <= LONG or special.search(p) else _INNER.split(p))]
    return found


def _counts(batches: Iterator[pa.RecordBatch], path: str, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    encode, cut = load(path)
    lengths = _Lengths(encode)
    for batch in batches:
        for part in slices(batch, "text", batch_bytes):
            texts = [t or "" for t in part.column("text").to_pylist()]
            if cut:
                found = [cut(t) for t in texts]
                lengths.learn(found)
                n = [sum(map(lengths.__getitem__, p)) for p in found]
            else:
                n = encode(texts)
            kept = {c: part.column(c) for c in part.schema.names if c != "text"}
            sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.record_batch([*kept.values(), sizes, pa.array(n, pa.int64())], names=[*kept, "n_bytes", "n_tokens"])


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every whole text, as the library of ``path`` counts them.

    No begin, end or added tokens, no truncation or padding; special strings inside texts are handled as the
    library does by default. Rows are encoded in batches of about ``batch_bytes``, and a batch's distinct pieces once.

    Texts are cut where no token reaches over. Byte-level .json tokenizers: before spaces that a visible character follows; a
    piece still longer than ``LONG`` also before other white space and at the end of letters and digits, so that lines
    and text without spaces are cut at punctuation. A .model whose pieces end with the word: at single spaces. A single run
    of letters has no safe boundary and goes whole, as do texts for other tokenizers.

    Null texts count as empty, with 0 tokens; very long texts are counted whole, one being the least a task holds; repeated rows are
    counted each; an empty table gives no rows; other columns of ``docs`` are not read, whatever their names.
    The file must be readable at ``path`` on every executor.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _counts(it, path, batch_bytes), f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
