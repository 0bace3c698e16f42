"""Removal of repeated byte strings with a sampled suffix array.

Every byte covered by a `window`-byte string that also starts in a document with a smaller id is removed.

1. Sampling. Of all suffixes those at window minima are kept: of the `gram`-byte strings inside each window the one of
   least hash names a sampled suffix. Equal windows sample the same place, so every repeated window shows up as two
   sampled suffixes that start with the same gram. About one suffix in 17 is sampled.
2. Screening. A suffix whose gram occurs in one document only cannot matter. Grams that several documents of one task
   share are settled there, and only their first and last document go on to meet the other tasks' grams, in buckets,
   packed: so a gram that a third of all documents share is a few postings per task.
3. Suffix array. Each remaining suffix, with the bytes its windows reach on either side, is range-partitioned by its
   leading bytes with sampled splitters. A gram stays in one partition unless it has more suffixes than a partition
   should hold; such a hot gram is dealt over partitions by document. A partition sorts its suffixes by multikey
   quicksort over 8-byte tokens and compares neighbours: equal suffixes of a larger document are covered whole; where
   suffixes share the gram and differ further on, their windows are compared, one offset from the suffix at a time.
4. Across boundaries. Only hot grams go on in other partitions: the windows that nothing in their partition covers meet
   once more in a grouped minimum.
5. The covered intervals travel to their documents, which are cut.

Documents with equal texts need no search: all but the one with the smallest id are covered whole.

Defined cases: null text is empty; texts shorter than the window keep everything; a null doc_id is no document with a
smaller id, loses nothing and removes nothing; rows that repeat a doc_id remove nothing from one another, whatever
their texts; repeated rows get the same result each; a text of any length is searched whole; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _bytes
from ._common import materialise, salted_join

U = np.uint64


@dataclass(frozen=True)
class SuffixParams:
    window: int = 50
    #: bytes of the gram; a multiple of 8
    gram: int = 16
    #: sampled suffixes in a screening bucket and sorted suffixes in a partition, on average
    bucket_rows: int = 250_000
    partition_rows: int = 150_000

    def __post_init__(self) -> None:
        if self.gram % 8 or not 0 <= self.window - self.gram <= 60:
            raise ValueError("the gram is a multiple of 8 bytes, and the window at most 60 bytes longer")


# ---------------------------------------------------------------- screening


def _packed(hashes: np.ndarray, docs: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """(bucket, blob) of grams sorted by hash: how many, then hashes, documents and how many suffixes each stands for."""
    bucket = (hashes >> U(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    blobs = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
        ids, at = np.unique(docs[a:b], return_inverse=True)
        wide = 2 if len(ids) < 1 << 16 else 4
        tail = hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
        head = np.array([len(ids), b - a, wide], "<i8").tobytes()
        more = np.flatnonzero(counts[a:b] > 1)
        rare = np.array([len(more)], "<i8").tobytes() + more.astype("<i4").tobytes() + counts[a:b][more].astype("<i8").tobytes()
        blobs.append(head + ids.astype("<i8").tobytes() + tail.tobytes() + at.astype(f"<u{wide}").tobytes() + rare)
    return pa.RecordBatch.from_pydict({"bucket": bucket[starts], "blob": blobs})


def _unpacked(blob: bytes, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_ids, n, wide = np.frombuffer(blob, "<i8", 3).tolist()
    at = 24
    ids = np.frombuffer(blob, "<i8", n_ids, at)
    at += 8 * n_ids
    full = np.zeros((n, 8), np.uint8)
    full[:, :7] = np.frombuffer(blob, np.uint8, 7 * n, at).reshape(-1, 7)
    at += 7 * n
    hashes = full.reshape(-1).view("<u8") & U((1 << 56) - 1)
    top = U((bucket << (64 - bits)) & ~((1 << 56) - 1))
    docs = ids[np.frombuffer(blob, f"<u{wide}", n, at)]
    at += wide * n
    (more,) = np.frombuffer(blob, "<i8", 1, at).tolist()
    counts = np.ones(n, np.int64)
    where = np.frombuffer(blob, "<i4", more, at + 8)
    counts[where] = np.frombuffer(blob, "<i8", more, at + 8 + 4 * more)
    return hashes | top, docs, counts


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _runs(*sorted_columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a new run of equal rows starts, and the index of each row's run."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_columns])
    return new, np.cumsum(new) - 1


def _sample(params: SuffixParams, bits: int):
    """mapInArrow: documents to packed grams (bucket, blob), and to the grams that documents of the task share (doc_id,
    grams). Of equal texts in a task only the smallest id so far counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        found: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            gram, doc, times = (np.concatenate(x) for x in (found, docs, counts))
            for x in (found, docs, counts):
                x.clear()
            order = np.lexsort((doc, gram))
            gram, doc, times = gram[order], doc[order], times[order]
            total = np.add.reduceat(times, np.flatnonzero(_runs(gram)[0]))
            fresh, _ = _runs(gram, doc)
            gram, doc = gram[fresh], doc[fresh]
            new, of = _runs(gram)
            size = np.bincount(of)
            ends = np.concatenate([new[1:], [True]])
            # the first of a gram's documents stands for the suffixes of all, but for one of the last's
            send = new | ends
            packed = _packed(gram[send], doc[send], np.where(new, total[of] - (size[of] > 1), 1)[send], bits)
            yield pa.RecordBatch.from_arrays(
                [*packed.columns, pa.nulls(len(packed), pa.int64()), pa.nulls(len(packed), pa.list_(pa.int64()))], names=names
            )
            shared = size[of] > 1
            gram, doc = gram[shared], doc[shared]
            order = np.argsort(doc, kind="stable")
            gram, doc = gram[order], doc[order]
            starts = np.flatnonzero(_runs(doc)[0]) if len(doc) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(np.append(starts, len(doc)).astype(np.int32), pa.array(gram.view(np.int64)))
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(doc[starts], pa.int64()), lists], names=names
            )

        names = ["bucket", "blob", "doc_id", "grams"]
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), _raw(batch.column("text"))):
                if doc is None or len(text) < params.window:
                    continue
                key = hashlib.blake2b(text, digest_size=16).digest()
                if seen.get(key, doc + 1) <= doc:
                    continue
                if len(seen) < 500_000:  # forgetting only costs work
                    seen[key] = doc
                h, times = np.unique(_bytes.minimizers(text, params.window, params.gram)[1], return_counts=True)
                found.append(h)
                docs.append(np.full(len(h), doc, np.int64))
                counts.append(times)
                held += len(h)
                if held > 2_000_000:
                    yield from flush()
                    held = 0
        if found:
            yield from flush()

    return run


def _shared(bits: int, hot_from: int):
    """applyInPandas: the grams of a bucket that two documents or more have, with those documents not yet told by their
    tasks; and (n instead of doc_id) the shared grams of at least hot_from suffixes."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(b, int(n), bits) for n, b in zip(bucket["bucket"], bucket["blob"])]
        gram, doc, count = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, gram))
        gram, doc, count = gram[order], doc[order], count[order]
        new, of = _runs(gram)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(gram)) - 1
        shared = (doc[starts] != doc[ends])[of]
        total = np.add.reduceat(count, starts) if len(starts) else np.empty(0, np.int64)
        fresh, _ = _runs(gram, doc)
        keep = shared & fresh
        loud = (total >= hot_from) & (doc[starts] != doc[ends])
        hot = starts[loud]
        told = pd.DataFrame({"doc_id": doc[keep], "gram": gram[keep].view(np.int64), "n": np.zeros(keep.sum(), np.int64)})
        many = pd.DataFrame({"doc_id": np.full(len(hot), -1), "gram": gram[hot].view(np.int64), "n": total[loud]})
        return pd.concat([told, many])

    return run


# ---------------------------------------------------------------- suffixes

#: meta: bytes right of the suffix start (7 bits), left of it (7), position (49)
def _meta(right: np.ndarray, left: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (right.astype(np.int64) << 56) | (left.astype(np.int64) << 49) | pos


def _parts(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return meta >> 56, (meta >> 49) & 127, meta & ((1 << 49) - 1)


def _suffixes(params: SuffixParams, hot):
    """mapInArrow: (doc_id, tag, z, grams) to the sampled suffixes with a shared gram: (lead, part, key, doc_id, tag, meta).

    part is 0, but for hot grams the number, from 1, of the part of its documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        loud, parts = hot.value
        for batch in batches:
            keys: list[bytes] = []
            columns: list[tuple] = []

            def flush():
                part, doc, tag, meta = (np.concatenate(x) for x in zip(*columns))
                lead = [k[: params.gram] for k in keys]
                return pa.RecordBatch.from_pydict({"lead": lead, "part": part, "key": keys, "doc_id": doc, "tag": tag, "meta": meta})

            grams = batch.column("grams")
            for i, (doc, tag, z) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "z")))):
                text = unzip.decompress(z)
                at, hashes, first, last = _bytes.minimizers(text, params.window, params.gram)
                wanted = grams[i].values.to_numpy(zero_copy_only=False).view(U)
                hit = np.isin(hashes, wanted)
                at, hashes, first, last = at[hit], hashes[hit], first[hit], last[hit]
                if not len(at):
                    continue
                part = np.zeros(len(at), np.int64)
                if len(loud):
                    place = np.minimum(np.searchsorted(loud, hashes), len(loud) - 1)
                    dealt = int(_bytes.mixed(np.array([doc], np.int64).view(U))[0] >> U(1))
                    part = np.where(loud[place] == hashes, 1 + dealt % parts[place], 0)
                ends = last + params.window
                keys += [text[s:e] + text[f:s] for s, e, f in zip(at.tolist(), ends.tolist(), first.tolist())]
                same = lambda x: np.full(len(at), x, np.int64)  # noqa: B023, E731
                columns.append((part, same(doc), same(tag), _meta(ends - at, at - first, at)))
                if len(keys) > 100_000:
                    yield flush()
                    keys, columns = [], []
            if keys:
                yield flush()

    return run


def _words(rows: np.ndarray) -> np.ndarray:
    """8-byte tokens of byte strings of one width (a multiple of 8), in the order of the bytes."""
    return np.ascontiguousarray(rows).view(">u8").astype(U)


def multikey_quicksort(tokens: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The order of rows of tokens, then of `last`: each pass sorts, by the next token, only what is still tied."""
    order = np.argsort(tokens[:, 0], kind="stable")
    group = np.zeros(len(order), np.int64)  # of the row at each place: where its tie starts
    lead = tokens[order, 0]
    new = np.concatenate([[True], lead[1:] != lead[:-1]]) if len(lead) else np.zeros(0, bool)
    for depth in range(1, tokens.shape[1] + 1):
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([starts, [len(order)]]))
        group = np.repeat(starts, sizes)
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            break
        rows = order[tied]
        by = tokens[rows, depth] if depth < tokens.shape[1] else last[rows]
        rank = np.lexsort((by, group[tied]))
        order[tied] = rows[rank]
        if depth == tokens.shape[1]:
            break
        by, of = by[rank], group[tied]
        split = np.concatenate([[True], (by[1:] != by[:-1]) | (of[1:] != of[:-1])])
        new[tied] = split
    return order


def _matrix(keys: list[bytes], width: int) -> np.ndarray:
    if not keys:
        return np.zeros((0, width), np.uint8)
    return np.array(keys, f"S{width}").view(np.uint8).reshape(-1, width)


def _contexts(keys: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Bytes left of the suffix moved before it."""
    n, width = keys.shape
    at = np.arange(width)[None, :]
    source = np.where(at < left[:, None], right[:, None] + at, at - left[:, None])
    return np.take_along_axis(keys, np.minimum(source, width - 1), 1)


def _windows(context: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """The window at `place` of every context, filled up to whole tokens."""
    out = np.zeros((len(place), (window + 7) // 8 * 8), np.uint8)
    out[:, :window] = np.lib.stride_tricks.sliding_window_view(context, window, axis=1)[np.arange(len(place)), place]
    return out


def _intervals(bits: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of every run of set bits."""
    on = (bits[:, None] >> np.arange(count)) & 1 == 1
    edge = np.zeros((len(bits), 1), bool)
    row, first = np.nonzero(on & ~np.hstack([edge, on[:, :-1]]))
    return row, first, np.nonzero(on & ~np.hstack([on[:, 1:], edge]))[1]


def _compare(params: SuffixParams):
    """mapInArrow over a sorted range of suffixes: covered intervals, and the suffixes of hot grams left to compare."""
    width = (2 * params.window - params.gram + 7) // 8 * 8
    offsets = params.window - params.gram + 1

    def partition(raw: np.ndarray, doc: np.ndarray, tag: np.ndarray, meta: np.ndarray, hot: np.ndarray) -> Iterator[dict]:
        right, left, _ = _parts(meta)
        order = multikey_quicksort(np.column_stack([_words(raw), ((right << 7) | left).astype(U)]), doc)
        raw, doc, tag, meta, hot = raw[order], doc[order], tag[order], meta[order], hot[order]
        right, left, pos = _parts(meta)
        tokens = _words(raw)
        _, of_gram = _runs(*tokens[:, : params.gram // 8].T)
        new_suffix, of_suffix = _runs(*tokens.T, right, left)
        del tokens
        least = doc[np.flatnonzero(new_suffix)][of_suffix]
        covered = doc > least
        yield {"doc_id": doc[covered], "tag": tag[covered], "start": (pos - left)[covered], "end": (pos + right)[covered]}
        several = np.bincount(of_gram[new_suffix])[of_gram] > 1
        # bit w: window w of the suffix is not known to be covered
        open_ = (np.int64(1) << (left + right - params.window + 1)) - 1
        here = np.flatnonzero(~covered & several)
        context = _contexts(raw[here], right[here], left[here])
        hits = np.zeros(len(here), np.int64)
        for offset in range(offsets):
            have = np.flatnonzero((left[here] >= offset) & (right[here] + offset >= params.window))
            if len(have) < 2:
                continue
            place = left[here[have]] - offset
            keyed, d = _words(_windows(context[have], place, params.window)), doc[here[have]]
            o = multikey_quicksort(keyed, d)
            new, of = _runs(*keyed[o].T)
            late = o[d[o] > d[o][np.flatnonzero(new)][of]]
            hits[have[late]] |= np.int64(1) << place[late]
        open_[here] &= ~hits
        row, first, last = _intervals(hits, offsets)
        m = here[row]
        begin = pos[m] - left[m]
        yield {"doc_id": doc[m], "tag": tag[m], "start": begin + first, "end": begin + last + params.window}
        far = ~covered & hot & (open_ != 0)
        if far.any():
            keys = [k[:n].tobytes() for k, n in zip(raw[far], (right + left)[far].tolist())]
            yield {"doc_id": doc[far], "tag": tag[far], "key": keys, "meta": meta[far], "open": open_[far]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [
            (_matrix(b.column("key").to_pylist(), width), *(b.column(c).to_numpy() for c in ("doc_id", "tag", "meta", "part")))
            for b in batches
            if len(b)
        ]
        if not parts:
            return
        raw, doc, tag, meta, part = (np.concatenate(x) for x in zip(*parts))
        del parts
        names = {"doc_id": pa.int64(), "tag": pa.int64(), "start": pa.int64(), "end": pa.int64(), "key": pa.binary(), "meta": pa.int64(), "open": pa.int64()}
        for out in partition(raw, doc, tag, meta, part > 0):
            n = len(out["doc_id"])
            for a in range(0, n, 100_000):
                some = slice(a, a + 100_000)
                columns = [pa.array(out[c][some], t) if c in out else pa.nulls(min(n - a, 100_000), t) for c, t in names.items()]
                yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return run


def _explode_windows(params: SuffixParams):
    """mapInArrow: suffixes of hot grams to those of their windows that no smaller document of the partition covers."""
    width = (2 * params.window - params.gram + 7) // 8 * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 5000):
                b = whole.slice(a, 5000)
                right, left, pos = _parts(b.column("meta").to_numpy())
                context = _contexts(_matrix(b.column("key").to_pylist(), width), right, left)
                row, place = np.nonzero((b.column("open").to_numpy()[:, None] >> np.arange(63)) & 1)
                bytes_ = _windows(context[row], place, params.window)
                yield pa.RecordBatch.from_pydict(
                    {
                        "bytes": [x[: params.window].tobytes() for x in bytes_],
                        "offset": (left[row] - place).astype(np.int64),
                        "doc_id": b.column("doc_id").to_numpy()[row],
                        "tag": b.column("tag").to_numpy()[row],
                        "start": (pos - left)[row] + place,
                    }
                )

    return run


# ---------------------------------------------------------------- cutting


def _cut(keep_text: bool):
    """mapInArrow: (doc_id, tag, z, covered) to the spans removed and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, tag, z, ivals in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "z", "covered"))):
                text = unzip.decompress(z)
                spans: list[list[int]] = []
                for start, end in sorted((x["start"], x["end"]) for x in ivals):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                kept, at = [], 0
                for start, end in spans:
                    kept.append(text[at:start])
                    at = end
                left = b"".join([*kept, text[at:]])
                rows.append((doc, tag, spans, hashlib.sha256(left).hexdigest(), left if keep_text else None))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                    "tag": pa.array([r[1] for r in rows], pa.int64()),
                    "spans": pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    "kept_sha256": pa.array([r[3] for r in rows], pa.string()),
                    "kept": pa.array([r[4] for r in rows], pa.binary()),
                }
            )

    return run


def _zipped(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, z): texts as they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = [zip_.compress(x) for x in _raw(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), pa.array(packed, pa.binary())], names=["doc_id", "tag", "z"])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, z binary")


def suffix_dedup(docs: DataFrame, params: SuffixParams = SuffixParams(), keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept) of every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    plain = materialise(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "sha"), "suffix-base")
    # the tag tells rows apart that repeat a doc_id with another text
    again = plain.where("doc_id is not null").groupBy("doc_id").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b")
    if again.limit(1).count():
        several = plain.join(again.select("doc_id"), "doc_id", "left_semi").select("doc_id", "sha").distinct()
        tags = several.withColumn("tag", F.row_number().over(W.partitionBy("doc_id").orderBy("sha")).cast("long"))
        tags = materialise(tags, "suffix-tags")
        tell = lambda df: df.join(tags, ["doc_id", "sha"], "left").withColumn("tag", F.coalesce("tag", F.lit(0)).cast("long"))
    else:
        tell = lambda df: df.withColumn("tag", F.lit(0).cast("long"))
    base, tagged = tell(plain), tell(rows)
    long_enough = base.where((F.col("n_bytes") >= params.window) & F.col("doc_id").isNotNull())
    first = long_enough.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("most"))
    copied = first.where("first < most").select("sha", "first")
    n_rows, total = plain.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    bits = 8
    while (total // 17) >> bits > params.bucket_rows and bits < 40:
        bits += 1
    sampled = materialise(
        rows.select("doc_id", "text").mapInArrow(_sample(params, bits), "bucket long, blob binary, doc_id long, grams array<long>"),
        "suffix-sample",
    )
    met = materialise(
        sampled.where("blob is not null").groupBy("bucket").applyInPandas(
            _shared(bits, params.partition_rows), "doc_id long, gram long, n long"
        ),
        "suffix-grams",
    )
    # at most one in partition_rows of the grams is hot
    loud = met.where("n > 0").select("gram", "n").toPandas()
    loud = loud.assign(gram=loud["gram"].to_numpy(np.int64).view(U)).sort_values("gram")
    parts_of = -(-loud["n"].to_numpy(np.int64) // params.partition_rows)
    hot = docs.sparkSession.sparkContext.broadcast((loud["gram"].to_numpy(U), parts_of))
    copies = salted_join(long_enough, copied, "sha", total=n_rows).where("doc_id > first").select("doc_id", "tag").distinct()
    of_tasks = sampled.where("grams is not null").select("doc_id", "grams")
    of_buckets = met.where("n = 0").groupBy("doc_id").agg(F.collect_list("gram").alias("grams"))
    lists = of_tasks.unionByName(of_buckets).groupBy("doc_id").agg(F.flatten(F.collect_list("grams")).alias("grams"))
    searched = long_enough.select("doc_id", "tag").distinct().join(copies, ["doc_id", "tag"], "left_anti")
    lists = searched.join(lists, "doc_id")
    # what comes back for repeated rows is the same; one of them is enough
    found = _zipped(tagged.where("doc_id is not null")).join(lists, ["doc_id", "tag"])
    suffixes = materialise(
        found.select("doc_id", "tag", "z", "grams").mapInArrow(
            _suffixes(params, hot), "lead binary, part long, key binary, doc_id long, tag long, meta long"
        ),
        "suffixes",
    )
    parts = max(12, -(-suffixes.count() // params.partition_rows))
    compared = materialise(
        suffixes.repartitionByRange(parts, "lead", "part").mapInArrow(
            _compare(params), "doc_id long, tag long, start long, end long, key binary, meta long, open long"
        ),
        "suffix-compared",
    )
    windows = compared.where("key is not null").select("doc_id", "tag", "key", "meta", "open").mapInArrow(
        _explode_windows(params), "bytes binary, offset long, doc_id long, tag long, start long"
    )
    least = windows.groupBy("bytes", "offset").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    late = windows.join(least.where("least < most").drop("most"), ["bytes", "offset"]).where("doc_id > least")
    covered = compared.where("key is null").select("doc_id", "tag", "start", "end").unionByName(
        late.select("doc_id", "tag", "start", (F.col("start") + params.window).alias("end"))
    )
    covered = covered.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("covered"))
    cut = _zipped(tagged.where("doc_id is not null")).join(covered, ["doc_id", "tag"])
    cut = cut.select("doc_id", "tag", "z", "covered").mapInArrow(
        _cut(keep_text), "doc_id long, tag long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept binary"
    )
    cut = cut.withColumnRenamed("kept_sha256", "cut_sha").dropDuplicates(["doc_id", "tag"])
    whole = copies.withColumn("copy", F.lit(True))
    out = base.join(whole, ["doc_id", "tag"], "left").join(cut, ["doc_id", "tag"], "left")
    gone = F.col("copy").isNotNull()
    none = F.array().cast("array<struct<start: long, end: long>>")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(gone, all_of_it).otherwise(F.coalesce("spans", none))
    out = out.withColumn("spans", spans)
    columns = [
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        "spans",
    ]
    if keep_text:
        columns.append(F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("cut"))
    return out.select(*columns)
