"""Exact substring deduplication by blocks around anchors and a lookup of the windows left over.

This stands in for relative Lempel-Ziv parsing: factors are not extended greedily and have no length, because that reads
another document's text word by word from every anchor, one factor after the other, while windows across the ends of a
factor would still need a lookup of their own. Blocks and windows give the same windows by hashes alone.

Every window of 20 words has one anchor: the run of 8 words with the smallest hash in it. The words
around an anchor that its windows can reach form a block. The index keeps the first place
of every block of the corpus; a document is compared with all of them at once:

1. a block whose words occur earlier is repeated as a whole, all its windows are duplicates;
2. a block that is itself a first place, but whose anchor also stands in other words, is a boundary:
   its windows are looked up one by one among the windows of all such blocks.

Equal windows have equal anchors, so both steps together find exactly the windows that start earlier
elsewhere. The windows of a document are merged to spans of words.

Only hashes of anchors (about one word in seven) and of boundary windows are shuffled, by hash, in packed
blocks, after each batch has dropped its own repetitions; so a passage that many documents share costs a row
per batch, and no group of equal passages meets in one task as rows.

Null texts have no words. A null doc_id sorts first. Rows that share doc_id and text are one document; rows
that share only doc_id are separate documents, ordered by the CRC-32 of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lutrin.llm.common import NULL_ID, U64, byte_batches, encoded, grams, long_rows, mixed, odd_numbers, release_memory, word_hashes, written

WINDOW = 20
GRAM = 8
REACH = WINDOW - GRAM
PLACE = ("doc", "crc", "pos")
ENTRY = [("k1", "<u8"), ("k2", "<u4"), ("doc", "<i8"), ("crc", "<u4"), ("pos", "<i4")]
BUCKET_BYTES = 64 << 20
LEAST_BUCKETS = 256
KEYED = "bucket int, entries binary"


def _windows(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside their document, the anchor of each, and all gram hashes."""
    g = grams(h, GRAM, 11)
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    least = np.lib.stride_tricks.sliding_window_view(mixed(g), REACH + 1).argmin(1) + np.arange(len(h) - WINDOW + 1)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends[:len(least)])
    return starts, least[starts], g


def _pack(rows: np.ndarray) -> bytes:
    """Bytes of the rows column by column, high and low bytes apart, which compresses well."""
    return len(rows).to_bytes(4, "little") + b"".join(
        np.ascontiguousarray(rows[name]).view(np.uint8).reshape(len(rows), rows.dtype[name].itemsize).T.tobytes() for name in rows.dtype.names)


def _unpack(blob: bytes, at: int, kind: list) -> tuple[np.ndarray, int]:
    n = int.from_bytes(blob[at:at + 4], "little")
    rows, at = np.empty(n, kind), at + 4
    for name, code in kind:
        width = np.dtype(code).itemsize
        column = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
        rows[name] = np.ascontiguousarray(column).view(code).ravel() if n else 0
        at += n * width
    return rows, at


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by key and place; which of them open a key; which repeat it at another place."""
    rows = rows[np.lexsort((rows["pos"], rows["crc"], rows["doc"], rows["k2"], rows["k1"]))]
    opens = np.ones(len(rows), bool)
    opens[1:] = (rows["k1"][1:] != rows["k1"][:-1]) | (rows["k2"][1:] != rows["k2"][:-1])
    first = rows[np.flatnonzero(opens)[np.cumsum(opens) - 1]] if len(rows) else rows
    again = ~opens & ((rows["pos"] != first["pos"]) | (rows["doc"] != first["doc"]) | (rows["crc"] != first["crc"]))
    return rows, opens, again


def _blobs(rows: np.ndarray, buckets: int) -> pd.DataFrame:
    """One row per bucket of keys: first places in this batch, and places already known to repeat one."""
    rows, opens, again = _ordered(rows)
    bucket = ((rows["k1"] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], len(rows)), strict=True):
        part = rows[a:b]
        known = part[again[a:b]][list(PLACE)]
        out.append((bucket[a], _pack(part[opens[a:b]]) + _pack(np.array(known, [x for x in ENTRY if x[0] in PLACE]))))
    return pd.DataFrame(out, columns=["bucket", "entries"])


def _met(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    places = [x for x in ENTRY if x[0] in PLACE]
    entries, known = [], []
    for blob in pdf["entries"]:
        rows, at = _unpack(blob, 0, ENTRY)
        entries.append(rows)
        known.append(_unpack(blob, at, places)[0])
    return (*_ordered(np.concatenate(entries)), known)


def _flat(parts: list[np.ndarray], edge: list[bool]) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({"doc": p["doc"], "crc": p["crc"].astype(np.int64), "pos": p["pos"], "edge": e})
                      for p, e in zip(parts, edge, strict=True)], ignore_index=True)


PLACES = "doc long, crc long, pos int, edge boolean"


def _factored(pdf: pd.DataFrame) -> pd.DataFrame:
    """Anchors whose block occurs earlier, and anchors of first blocks that other words share."""
    rows, opens, again, known = _met(pdf)
    opened = np.flatnonzero(opens)
    same = rows["k1"][opened]
    shared = np.zeros(len(opened), bool)
    shared[1:] = same[1:] == same[:-1]
    shared[:-1] |= shared[1:]
    return _flat([rows[again], *known, rows[opened[shared]]], [False] * (1 + len(known)) + [True])


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    rows, _, again, known = _met(pdf)
    return _flat([rows[again], *known], [False] * (1 + len(known)))


def _entries(k1, k2, doc, crc, pos) -> np.ndarray:
    rows = np.empty(len(k1), ENTRY)
    rows["k1"], rows["k2"], rows["doc"], rows["crc"], rows["pos"] = k1, k2 >> U64(32), doc, crc, pos
    return rows


def _batches(pdfs: Iterator[pd.DataFrame], wanted: str | None = None):
    """Per batch: rows, word hashes, document bounds, and document number per word."""
    for pdf in pdfs:
        if wanted:
            pdf = pdf[[x is not None and len(x) > 0 for x in pdf[wanted]]]
        texts = pdf["text"].to_numpy()
        for chosen in byte_batches(range(len(texts)), lambda i: len(texts[i] or "")):
            part = pdf.iloc[chosen]
            h, counts = word_hashes(encoded(part["text"]))
            yield part, h, np.concatenate(([0], np.cumsum(counts))), np.repeat(np.arange(len(counts)), counts)


def _block_keys(h: np.ndarray, bounds: np.ndarray, owner: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Hash of the words around every anchor that its windows can reach."""
    low = np.maximum(bounds[owner[anchors]], anchors - REACH)
    high = np.minimum(bounds[owner[anchors] + 1], anchors + WINDOW)
    place, total = odd_numbers(2 * WINDOW, 23), np.zeros(len(anchors), U64)
    with np.errstate(over="ignore"):
        for k in range(-REACH, WINDOW):
            at = anchors + k
            inside = (at >= low) & (at < high)
            total += np.where(inside, h[np.clip(at, 0, len(h) - 1)] * place[k + REACH], U64(0))
        return mixed(total + (anchors - low).astype(U64) * U64(64) + (high - anchors).astype(U64))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with their place in the order; names that begin with `_lutrin` are kept for helper columns."""
    return docs.withColumns({"_lutrin_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)),
                             "_lutrin_crc": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})


def _collected(places: DataFrame, **kinds) -> DataFrame:
    return places.groupBy(F.col("doc").alias("_lutrin_doc"), F.col("crc").alias("_lutrin_crc")).agg(
        *[F.collect_list(F.when(kind, F.col("pos"))).alias(name) for name, kind in kinds.items()])


def duplicate_words(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any more) with `_lutrin_spans`: runs [start, end) of words covered by repeated windows."""
    keyed = _keyed(long_rows(docs))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)

    def anchored(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, h, bounds, owner in _batches(pdfs):
            _, anchor, g = _windows(h, bounds)
            a = np.unique(anchor)
            if len(a):
                o = owner[a]
                yield _blobs(_entries(g[a], _block_keys(h, bounds, owner, a), part["_lutrin_doc"].to_numpy()[o],
                                      part["_lutrin_crc"].to_numpy()[o], a - bounds[o]), buckets)
        release_memory()

    def bounded(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, h, bounds, owner in _batches(pdfs, "_lutrin_edges"):
            start, anchor, _ = _windows(h, bounds)
            edges = np.concatenate([np.asarray(x, np.int64) + b for x, b in zip(part["_lutrin_edges"], bounds[:-1], strict=True)])
            s = start[np.isin(anchor, edges)]
            if len(s):
                o = owner[s]
                yield _blobs(_entries(grams(h, WINDOW, 31)[s], grams(h, WINDOW, 37)[s], part["_lutrin_doc"].to_numpy()[o],
                                      part["_lutrin_crc"].to_numpy()[o], s - bounds[o]), buckets)
        release_memory()

    anchors = (keyed.select("_lutrin_doc", "_lutrin_crc", "text").mapInPandas(anchored, KEYED)
               .groupBy("bucket").applyInPandas(_factored, PLACES))
    factors = written(_collected(anchors, _lutrin_factors=~F.col("edge"), _lutrin_edges=F.col("edge")))
    first = keyed.join(factors, ["_lutrin_doc", "_lutrin_crc"], "left")
    windows = first.mapInPandas(bounded, KEYED).groupBy("bucket").applyInPandas(_repeated, PLACES)
    marked = first.join(_collected(windows, _lutrin_starts=~F.col("edge")), ["_lutrin_doc", "_lutrin_crc"], "left")
    spans = _spans("text", "_lutrin_factors", "_lutrin_starts")
    return marked.withColumn("_lutrin_spans", spans).select(*docs.columns, "_lutrin_spans")


def _spans(*columns: str):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def merged(text: pd.Series, factors: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for x, f, s in zip(text, factors, starts, strict=True):
            covered = [np.asarray(s, np.int64)] if s is not None and len(s) else []
            if f is not None and len(f):
                h, counts = word_hashes(encoded([x]))
                start, anchor, _ = _windows(h, np.array([0, counts[0]]))
                covered.append(start[np.isin(anchor, np.asarray(f))])
            at = np.unique(np.concatenate(covered)) if covered else np.zeros(0, np.int64)
            cuts = np.flatnonzero(np.diff(at, prepend=-WINDOW - 1) > WINDOW)
            last = np.append(cuts[1:], len(at))[:len(cuts)] - 1
            out.append([{"start": int(at[a]), "end": int(at[b]) + WINDOW} for a, b in zip(cuts, last, strict=True)])
        return pd.Series(out, dtype=object)

    return merged(*columns)


def _kept_runs(words: list, spans) -> Iterator[list]:
    at = 0
    for span in spans if spans is not None else ():
        yield words[at:span["start"]]
        at = span["end"]
    yield words[at:]


def kept_digest(text, spans):
    """Struct of n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def digest(texts: pd.Series, all_spans: pd.Series) -> pd.DataFrame:
        out = []
        for x, spans in zip(encoded(texts), all_spans, strict=True):
            words = x.split()
            kept = [w for run in _kept_runs(words, spans) for w in run]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    return digest(text, spans)


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs with repeated words cut from `text` (and `n_chars`, if present, counted anew).

    Texts without repeated words stay as they are; documents of which nothing is left go.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(w for run in _kept_runs(x.split(), spans) for w in run).decode("utf-8", "surrogatepass")
                          for x, spans in zip(encoded(texts), all_spans, strict=True)], dtype=object)

    marked = duplicate_words(docs).withColumn("_lutrin_left", F.when(F.size("_lutrin_spans") > 0, cut("text", "_lutrin_spans")))
    left = F.col("_lutrin_left")
    new = {"text": F.coalesce(left, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(left.isNotNull(), F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return marked.filter(left.isNull() | (left != "")).select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
