"""Substring dedup by hashing lines, paragraphs or sentences."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends of units: what a pattern matches belongs to the unit before it.
LINES, PARAGRAPHS, SENTENCES = r"\n", r"\n[ \t\r]*\n\s*", r"\n|(?<=[.!?])[ \t]+"
#: Ends of sentences within a line: any white space that digest() takes for a space, so lines alike have sentences alike;
#: only where text follows, so a sentence is never its whole line.
WITHIN = r"(?<=[.!?。！？])[ \t\r\f\v]+(?=\S)|(?<=[。！？])(?=\S)"
#: Letters of scripts without spaces between words: two of them count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f]")


def units(text: str, ends: re.Pattern) -> Iterator[tuple[int, int]]:
    """(start, end) of the units of a text: they touch, and together they are the text."""
    at = 0
    for m in ends.finditer(text):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def n_words(unit: str) -> int:
    """The words of a unit, where two letters of a script without spaces count as a word too."""
    n = len(unit.encode("utf-8", "surrogatepass").split())
    return n if unit.isascii() or not n else max(n, len(_UNSPACED.findall(unit)) // 2)


def digest(unit: str, min_words: int) -> bytes | None:
    """128 bits of the words in lower case (A-Z only) joined by single spaces; None for fewer than min_words words."""
    w = unit.encode("utf-8", "surrogatepass").lower().split()
    if len(w) < min_words and (not w or unit.isascii() or n_words(unit) < min_words):
        return None
    return hashlib.md5(b" ".join(w)).digest()


def dedup_units(docs: DataFrame, ends: str = LINES, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text", inner: str | None = None, inner_words: int = 5, run_words: int = 0) -> DataFrame:
    """A row for each row of docs: doc_id, text, n_units, n_removed, removed (array of start, end, first_id).

    A text is divided into units, each with the separator behind it. Of all units of the table that are alike when
    normalised (A-Z in lower case, single spaces) the earliest stays, that of the smallest doc_id and then of the first
    place in the text; the others are cut out. Units of fewer than min_words words always stay. If inner is given, the
    units that don't go as a whole are divided by it, and of those parts and all units the earliest stays as well; parts
    of fewer than inner_words words always stay; n_units then counts the parts. With run_words, what repeats is cut out
    only where units that repeat, one after the other, have so many words together: a passage goes, a phrase or a line that
    many documents happen to have stays. Units that always stay don't end such a run. Spans are offsets into
    the original text in code points, ends exclusive; first_id is the document whose unit stays.
    A null text gives null, an empty one '', with no units. Null doc_ids come last; documents are told apart by doc_id
    and text, so rows alike in both share their fate and count as one. Other columns are ignored; an empty table gives an
    empty result. Digests are grouped over the whole table, one for each document that has them; the texts are dealt
    once, by document, next to what is known of their repeated units.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("twin", F.xxhash64("text"))
    pattern, within = re.compile(ends), re.compile(inner) if inner else None

    def divided(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """Each unit and, where there are several, its parts."""
        for start, end in units(text, pattern):
            parts = [(start + a, start + b) for a, b in units(text[start:end], within)] if within else []
            yield start, end, parts if len(parts) > 1 else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, text, twin in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen: dict[bytes, list[int]] = {}
                for k, (start, end, parts) in enumerate(divided(text or "")):
                    if (d := digest(text[start:end], min_words)) is not None:
                        seen.setdefault(d, [k, 0])[1] += 1
                    for a, b in parts:
                        if (d := digest(text[a:b], inner_words)) is not None:
                            seen.setdefault(d, [k, 0])[1] += 1
                rows.extend((d, i, twin, *at) for d, at in seen.items())
                if len(rows) >= 100_000:
                    yield _table(rows)
                    rows = []
            yield _table(rows)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "doc_id", "twin", "place", "times"])

    found = base.mapInArrow(scan, "digest binary, doc_id long, twin long, place int, times int")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("twin"))
    repeated = found.groupBy("digest").agg(F.sum("times").alias("n"), F.min(rank).alias("first")).where("n > 1").drop("n")
    told = found.join(repeated, "digest").select("doc_id", "twin", "digest", F.col("first.doc_id").alias("first_id"), (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.twin") == F.col("twin"))).alias("own"))
    # of one document, at most one entry for each of its units
    told = told.groupBy(F.col("doc_id").alias("_id"), F.col("twin").alias("_twin")).agg(F.collect_set(F.struct("digest", "first_id", "own")).alias("told"))
    joined = base.join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("twin") == F.col("_twin")), "left").select("doc_id", "text", "told")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, text, told in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans = list(divided(text or ""))
                known = {x["digest"]: x for x in told or ()}
                gone: list[dict] = []
                run: list[dict] = []
                length = 0

                def repeats(start: int, end: int, least: int) -> bool | None:
                    """Whether a unit repeats an earlier one; None for one that always stays."""
                    nonlocal length
                    d = digest(text[start:end], least)
                    if d is None:
                        return None
                    x = known.get(d)
                    if x and not x["own"]:
                        run.append({"start": start, "end": end, "first_id": x["first_id"]})
                        length += n_words(text[start:end])
                        return True
                    if x:
                        x["own"] = False  # the first one stays
                    return False

                def ended() -> None:
                    nonlocal length
                    if length >= run_words:
                        gone.extend(run)
                    run.clear()
                    length = 0

                for start, end, parts in spans if known else ():
                    told_ = repeats(start, end, min_words)
                    if not told_ and parts:
                        for a, b in parts:
                            if repeats(a, b, inner_words) is False:
                                ended()
                    elif told_ is False:
                        ended()
                ended()
                if gone:
                    edges = [0, *(e for g in gone for e in (g["start"], g["end"])), len(text)]
                    text = "".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                for column, value in zip(out, (i, text, sum(max(1, len(parts)) for _, _, parts in spans), len(gone), gone), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_id", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "text", "n_units", "n_removed", "removed"])

    return joined.mapInArrow(remove, "doc_id long, text string, n_units int, n_removed int, removed array<struct<start:int,end:int,first_id:long>>")
