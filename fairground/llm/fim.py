"""Fill-in-middle transformation, its cuts found by big-integer bit-parallelism."""

from __future__ import annotations

from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairground.llm.common import small_batches

#: What stands before the three parts of a document.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


def _mask(members) -> bytes:
    """A table for bytes.translate: `1` for the bytes of a class, `0` for all others."""
    return bytes(b"01"[b in members] for b in range(256))


#: Classes of bytes in UTF-8: all but the first of a code point, line feeds, blanks.
_INNER, _FEED, _BLANK = _mask(range(0x80, 0xC0)), _mask(b"\n"), _mask(b" \t\n\v\f\r")


def _bits(text: bytes, table: bytes) -> int:
    """An integer whose bit i says whether byte i is of the class."""
    return int(text.translate(table)[::-1], 2) if text else 0


def unit_ends(text: bytes, unit: str = "char") -> int:
    """Bit i is set where a unit ends with byte i: a code point (`char`), a `line` with its line feed, or a
    `word` with the blanks before it. The last byte of a text always ends one."""
    if not text:
        return 0
    whole = (1 << len(text)) - 1
    inner = _bits(text, _INNER)
    last = 1 << len(text) - 1
    if unit == "char":
        return (whole ^ inner) >> 1 | last
    if unit == "line":
        return _bits(text, _FEED) | last
    blank = _bits(text, _BLANK)
    return (whole ^ blank) & blank >> 1 | last


def select(mask: int, size: int, rank: int) -> int:
    """Where the rank-th set bit is, from 1, of the lowest `size` bits: halved until one bit is left, always
    on into the half that holds it, so that the work is that of reading the mask twice."""
    at = 0
    while size > 1:
        half = size >> 1
        low = mask & (1 << half) - 1
        n = low.bit_count()
        if rank <= n:
            mask, size = low, half
        else:
            mask, size, rank, at = mask >> half, size - half, rank - n, at + half
    return at


def draws(doc_id, seed: int) -> list[int]:
    """Four 32-bit numbers that depend on the document's id and the seed only; a null id counts as none."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transform(doc_id, text: bytes, rate: int, spm: int, seed: int, unit: str) -> tuple:
    """n, form, units of the prefix and of the middle (null if plain), output."""
    ends = unit_ends(text, unit)
    n = ends.bit_count()
    first, second, use, order = draws(doc_id, seed)
    if not text or use % 100 >= rate or any(m in text for m in _MARKS):
        return n, "plain", None, None, text
    a, b = sorted((first % (n + 1), second % (n + 1)))
    p, m = (select(ends, len(text), k) + 1 if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    if order % 100 < spm:
        return n, "spm", a, b - a, b"".join((_MARKS[1], suffix, _MARKS[0], prefix, _MARKS[2], middle))
    return n, "psm", a, b - a, b"".join((_MARKS[0], prefix, _MARKS[1], suffix, _MARKS[2], middle))


def _transformed(batches, rate: int, spm: int, seed: int, unit: str, schema: pa.Schema):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        made = [transform(i, t or b"", rate, spm, seed, unit) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
        n, form, prefix, middle, output = zip(*made, strict=True) if made else ((),) * 5
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, seed: int = 1, unit: str = "char", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents rearranged so that a model learns to fill in their middle.

    rate percent of them are cut in three at two of their units' ends, drawn from the id alone, so that a task
    run again cuts alike: `spm` percent of these become suffix, prefix, middle, the others prefix, suffix,
    middle, with a mark before each part. Texts that hold a mark stay plain, so that every output can be
    undone (restored). Each row by itself: no shuffle, and a batch of texts in memory.

    Returns doc_id, n (units), form (plain, psm, spm), prefix_units, middle_units (null if plain), output. Null
    and empty texts are plain and empty; repeated rows come out as often, a null id draws as no digits do;
    other columns are ignored; an empty table gives no rows."""
    if unit not in ("char", "word", "line"):
        raise ValueError(f"unit is {unit}, not char, word or line")
    small_batches(docs.sparkSession)
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("output", pa.string())])
    run = partial(_transformed, rate=rate, spm=spm, seed=seed, unit=unit, schema=arrow)
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of a document, from its output and form alone: no part holds a mark, so the first of each
    ends the part before it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """The contract's columns of fill_in_middle by code points: what came out and what it restores to, as SHA-256."""
    text = restored(F.col("output"), F.col("form"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(text).alias("restored_sha256"))
