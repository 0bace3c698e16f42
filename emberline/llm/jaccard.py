"""N-gram Jaccard join with token-combination prefixes.

Two documents link if their sets of word shingles have a Jaccard similarity of at least num/den. Documents with the same
set form one class, whose smallest doc_id stands for it. For the rest:

1. Order. All shingles have one global order: first those that are not heavy, by hash, then the heavy ones by count.
   Heavy hitters come from counts per task that add up; which shingles count as heavy only decides the order and the
   class of a token, never the result.
2. Prefixes. A set of n must share a token of its first n - need + 1 with any partner; the smaller set of a pair even of
   a shorter prefix. Rare tokens are indexed singly. Tokens of the frequent class (in at least `frequent` of all
   documents) are not: prefixes are extended by one, in which a pair that shares no rare token must share two frequent
   ones, and the pairs of frequent tokens are indexed instead.
3. Candidates. Postings meet in buckets, packed; size and position bounds prune pairs, and a token that very many sets
   may hold is dealt over several buckets. Short posting lists give all their pairs. Long ones, as of thousands of near
   copies, first give pairs of neighbours only, by size and in a few seeded orders, and pairs with the first member.
   After these are verified, members in different components meet again: first those near each other in the seeded
   order, at last all of them, list by list, and very long lists in pairs of blocks. Parity bitmaps of the sets (the
   bits in which two differ are a lower bound of the tokens in which they do) drop most pairs that can't link before
   they leave the task. Pairs inside a component are never needed, so a group of near copies costs its size, not its
   square.
4. Verification. Each pair gets both texts, compressed, and the exact sets are compared.
5. Components over the links, distributed; each round starts from the components of the one before.

Defined cases: null or blank text has no shingles and links with nothing; texts of fewer than five words have one
shingle of all their words; rows that repeat a doc_id are one document with the links of all its texts; a null doc_id
takes no part (its component is null); an empty table gives an empty result; a text of any length is taken whole; columns named n_shingles or component_id
are replaced where rows are returned, other columns pass through.
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
from ._common import materialise, salted_join, zipped
from ._components import components

U = np.uint64


@dataclass(frozen=True)
class JaccardParams:
    num: int = 80
    den: int = 100
    words: int = 5
    #: heavy shingles kept for the order, and the count from which a shingle may be one
    heavy: int = 200_000
    heavy_least: int = 24
    #: the frequent class: shingles in at least one of so many documents
    frequent: int = 100
    frequent_least: int = 200
    #: posting lists up to this length give all their pairs at once; longer ones neighbours in so many seeded orders
    short_list: int = 8
    orders: int = 2
    #: how far apart in a seeded order members of different components meet in the second round
    steps: int = 16
    bucket_rows: int = 250_000
    #: members of a posting list that meet in one task: of the first round on average, of the later ones at most twice
    list_rows: int = 50_000
    block_rows: int = 4096
    #: ids are broadcast to select documents up to this many, and joined by a shuffle beyond
    broadcast_ids: int = 500_000


def _need(n, p: JaccardParams):
    """Least overlap of a set of n with any partner."""
    return -(-p.num * n // p.den)


def _need_as_smaller(n, p: JaccardParams):
    """Least overlap of a set of n with a partner of at least its size."""
    return -(-2 * p.num * n // (p.num + p.den))


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------- sets, heavy tokens, prefixes


def _local_counts(p: JaccardParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= 3
            return pa.RecordBatch.from_pydict({"token": tokens[keep].view(np.int64), "n": counts[keep].astype(np.int64)})

        for batch in batches:
            for s in _bytes.shingles(_raw(batch.column("text")), p.words):
                held.append(s)
                size += len(s)
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def heavy_tokens(docs: DataFrame, p: JaccardParams) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (sorted) and counts of at most p.heavy heavy shingles."""
    counts = docs.select("text").mapInArrow(_local_counts(p), "token long, n long")
    top = counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= p.heavy_least)
    rows = top.orderBy(F.desc("n"), "token").limit(p.heavy).toPandas()
    tokens, n = rows["token"].to_numpy(np.int64).view(U), rows["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _parity(s: np.ndarray) -> bytes:
    """One bit per place, at least as many as tokens: whether an odd number of tokens falls on it."""
    places = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & U(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _described(p: JaccardParams):
    """mapInArrow: (doc_id, text) to (doc_id, n, sig, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _bytes.shingles(_raw(batch.column("text")), p.words)
            sig = [hashlib.sha1(s.tobytes()).digest() for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            bits = [_parity(s) if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n, pa.array(sig, pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "n", "sig", "bits"]
            )

    return run


def _prefixes(p: JaccardParams, heavy, frequent_from: int):
    """mapInArrow: (doc_id, text) to (sig, doc_id, n, singles, prefix), the prefix's first `singles` tokens being rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = heavy.value
        for batch in batches:
            rows = []
            docs = batch.column("doc_id").to_pylist()
            for doc, s in zip(docs, _bytes.shingles(_raw(batch.column("text")), p.words)):
                n = len(s)
                if n < 4 or doc is None:  # smaller sets are alike only if equal
                    continue
                take = n - _need(n, p) + 2
                singles = take
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    is_heavy = tokens[at] == s
                    light = s[~is_heavy]
                    if len(light) >= take:
                        prefix = light[:take]
                    else:
                        count = counts[at[is_heavy]]
                        order = np.lexsort((s[is_heavy], count))
                        prefix = np.concatenate([light, s[is_heavy][order]])[:take]
                        singles = min(take, len(light) + int((count < frequent_from).sum()))
                else:
                    prefix = s[:take]
                rows.append((hashlib.sha1(s.tobytes()).digest(), doc, n, singles, prefix.tobytes()))
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["sig", "doc_id", "n", "singles", "prefix"]
                )

    return run


# ---------------------------------------------------------------- postings


def _postings(p: JaccardParams, bits: int, heavy):
    """mapInArrow: prefixes to packed postings (bucket, blob): key, document, size, position, fit to be the smaller
    and whether the key is dealt over several buckets.

    The bucket hangs on the key and, for keys that more than list_rows sets may hold, on the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_at, counts = heavy.value
        held: list[tuple] = []
        size = 0

        def flush():
            key, doc, n, pos, small, salts = (np.concatenate(x) for x in zip(*held))
            salt = _bytes.mixed(doc.astype(U)) % salts
            bucket = (_bytes.mixed(key + salt) >> U(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, doc, n, pos, small, bucket = key[order], doc[order], n[order], pos[order], small[order], bucket[order]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
                ids, first, at = np.unique(doc[a:b], return_index=True, return_inverse=True)
                wide = 2 if len(ids) < 1 << 16 else 4
                out.append(
                    np.array([len(ids), b - a, wide], "<i8").tobytes()
                    + ids.astype("<i8").tobytes()
                    + n[a:b][first].astype("<i4").tobytes()
                    + key[a:b].astype("<u8").tobytes()
                    + at.astype(f"<u{wide}").tobytes()
                    + (pos[a:b].astype("<u4") << 2 | small[a:b]).astype("<u4").tobytes()
                )
            return pa.RecordBatch.from_pydict({"bucket": bucket[starts], "blob": out})

        def holders(tokens: np.ndarray) -> np.ndarray:
            """How many sets hold each token, as far as it is heavy; 0 else."""
            if not len(tokens_at):
                return np.zeros(len(tokens), np.int64)
            at = np.minimum(np.searchsorted(tokens_at, tokens), len(tokens_at) - 1)
            return np.where(tokens_at[at] == tokens, counts[at], 0)

        for batch in batches:
            for doc, n, singles, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "singles", "prefix"))):
                tokens = np.frombuffer(raw, "<u8")
                plain = n - _need(n, p) + 1
                as_small = n - _need_as_smaller(n, p) + 1
                alone = min(plain, singles)
                at = np.arange(alone)
                count = holders(tokens)
                keys, pos, small, of = [tokens[:alone]], [at], [at < as_small], [count[:alone]]
                rest = np.arange(singles, len(tokens))
                if len(rest) > 1:
                    i, j = np.triu_indices(len(rest), 1)
                    i, j = rest[i], rest[j]
                    keys.append(_bytes.mixed(_bytes.mixed(tokens[i]) + tokens[j]))
                    pos.append(i)
                    small.append(j < as_small + 1)
                    of.append(np.minimum(count[i], count[j]))
                key = np.concatenate(keys)
                if len(key):
                    salts = (np.concatenate(of) // p.list_rows + 1).astype(U)
                    same = lambda x: np.full(len(key), x, np.int64)
                    small = np.concatenate(small).astype(np.uint32) | (salts > 1).astype(np.uint32) << 1
                    held.append((key, same(doc), same(n), np.concatenate(pos), small, salts))
                    size += len(key)
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    n_ids, n, wide = np.frombuffer(blob, "<i8", 3).tolist()
    at = 24
    ids = np.frombuffer(blob, "<i8", n_ids, at)
    at += 8 * n_ids
    sizes = np.frombuffer(blob, "<i4", n_ids, at)
    at += 4 * n_ids
    key = np.frombuffer(blob, "<u8", n, at)
    at += 8 * n
    who = np.frombuffer(blob, f"<u{wide}", n, at)
    at += wide * n
    pos = np.frombuffer(blob, "<u4", n, at)
    flags = (pos & 1).astype(bool), (pos & 2).astype(bool)
    return key, ids[who], sizes[who].astype(np.int64), (pos >> 2).astype(np.int64), *flags


def _fits(p: JaccardParams, n_i, pos_i, small_i, n_j, pos_j) -> np.ndarray:
    """Whether a pair (i not larger than j) that first shares the token at these positions can reach the threshold."""
    need = -(-p.num * (n_i + n_j) // (p.num + p.den))
    return small_i & (p.den * n_i >= p.num * n_j) & (np.minimum(n_i - pos_i, n_j - pos_j) >= need)


def _seeded(doc: np.ndarray, seed: int) -> np.ndarray:
    return _bytes.mixed(doc.astype(U) * U(2 * seed + 1) + U(seed))


def _couples(doc: np.ndarray, i: list[np.ndarray], j: list[np.ndarray]) -> np.ndarray:
    """The distinct pairs of ids, the smaller first."""
    a, b = (doc[np.concatenate(x)] if x else np.empty(0, np.int64) for x in (i, j))
    return np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)


def _candidates(p: JaccardParams):
    """applyInPandas over a bucket: the first pairs (a, b), and the members of long posting lists (key, a, n, pos, small)."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        columns = [np.concatenate(x) for x in zip(*map(_unpacked, bucket["blob"]))]
        order = np.lexsort((columns[1], columns[2], columns[0]))
        key, doc, n, pos, small, dealt = (x[order] for x in columns)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        length = np.diff(np.concatenate([starts, [len(key)]]))
        of = np.cumsum(new) - 1
        size, end = length[of], (starts + length)[of]
        long_ones = (size > p.short_list) | dealt
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []

        def add(i: np.ndarray, j: np.ndarray) -> None:
            ok = _fits(p, n[i], pos[i], small[i], n[j], pos[j]) & (doc[i] != doc[j])
            left.append(i[ok])
            right.append(j[ok])

        i, step = np.flatnonzero(size > 1), 1
        while len(i):
            i = i[(i + step < end[i]) & ((step == 1) | ~long_ones[i])]
            add(i, i + step)
            step += 1
        m = np.flatnonzero(long_ones)
        first = starts[of[m]]
        add(first[first < m], m[first < m])
        for seed in range(1, p.orders + 1):
            o = m[np.lexsort((_seeded(doc[m], seed), of[m]))]
            x, y = o[:-1], o[1:]
            x, y = x[of[x] == of[y]], y[of[x] == of[y]]
            add(np.minimum(x, y), np.maximum(x, y))
        pairs = _couples(doc, left, right)
        none = np.full(len(pairs), -1, np.int64)
        return pd.DataFrame(
            {
                "listed": np.concatenate([np.zeros(len(pairs), bool), np.ones(len(m), bool)]),
                "key": np.concatenate([none, key[m].view(np.int64)]),
                "a": np.concatenate([pairs[:, 0], doc[m]]),
                "b": np.concatenate([pairs[:, 1], np.full(len(m), -1, np.int64)]),
                "n": np.concatenate([none, n[m]]),
                "pos": np.concatenate([none, pos[m]]),
                "small": np.concatenate([none > 0, small[m]]),
            }
        )

    return run


class _Parities:
    """Parity bitmaps of many sets. Wider ones fold to half their width, so sets of unlike widths compare as well."""

    def __init__(self, bitmaps: list[bytes]):
        self.words = np.array([len(b) // 8 for b in bitmaps], np.int64)
        own = {w: np.flatnonzero(self.words == w) for w in np.unique(self.words).tolist()}
        raw = {w: np.frombuffer(b"".join(bitmaps[i] for i in at), "<u8").reshape(-1, w) for w, at in own.items()}
        self.rows, self.levels = {}, {}
        for w, at in own.items():
            parts, row = [raw[w]], np.full(len(bitmaps), -1, np.int64)
            row[at] = np.arange(len(at))
            if (wider := own.get(2 * w)) is not None:
                row[wider] = len(at) + np.arange(len(wider))
                parts.append(raw[2 * w][:, :w] ^ raw[2 * w][:, w:])
            self.rows[w], self.levels[w] = row, np.concatenate(parts)

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At least how many tokens are in one of the two sets only; 0 where widths are too unlike to say."""
        out = np.zeros(len(i), np.int64)
        width = np.minimum(self.words[i], self.words[j])
        for w in np.unique(width).tolist():
            row, bits = self.rows[w], self.levels[w]
            at = np.flatnonzero((width == w) & (row[i] >= 0) & (row[j] >= 0))
            for part in np.array_split(at, len(at) * w // 1_000_000 + 1):
                out[part] = np.bitwise_count(bits[row[i[part]]] ^ bits[row[j[part]]]).sum(1)
        return out


def _across(p: JaccardParams, steps: int):
    """applyInPandas over posting lists: pairs of members in different components that may link.

    steps: how far apart members in a seeded order meet; 0: all of them meet. Lists in pairs of blocks (own is the
    member's block, lo <= hi those of the pair) give the pairs between the two.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key, doc, n, pos, small, comp = (rows[c].to_numpy() for c in ("key", "a", "n", "pos", "small", "component"))
        between, own = (rows["lo"] != rows["hi"]).to_numpy(), rows["own"].to_numpy()
        by_size = np.lexsort((doc, n, key))
        order = np.lexsort((_seeded(doc, 1), key)) if steps else by_size
        # where a member stands by (size, id) tells which of a pair is the smaller
        standing = np.empty(len(order), np.int64)
        standing[by_size] = np.arange(len(order))
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        several = np.minimum.reduceat(comp[order], starts) != np.maximum.reduceat(comp[order], starts)
        keep = several[np.cumsum(new) - 1]
        order, key = order[keep], key[keep]
        if not len(order):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        doc, n, pos, small, comp, between, own, standing = (x[order] for x in (doc, n, pos, small, comp, between, own, standing))
        parities = _Parities(rows["bits"].iloc[order].tolist())
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        end = np.concatenate([starts[1:], [len(key)]])[np.cumsum(new) - 1]
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        i, step = np.arange(len(key)), 1
        while len(i) and not 0 < steps < step:
            i = i[i + step < end[i]]
            if not steps:  # in order of size, what is too large for i stays so
                i = i[p.den * n[i] >= p.num * n[i + step]]
            j = i + step
            ok = (comp[i] != comp[j]) & (~between[i] | (own[i] != own[j])) & (doc[i] != doc[j])
            x, y = i[ok], j[ok]
            swap = standing[x] > standing[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            ok = _fits(p, n[x], pos[x], small[x], n[y], pos[y])
            x, y = x[ok], y[ok]
            most = (n[x] + n[y] - parities.differ(x, y)) // 2
            ok = most >= -(-p.num * (n[x] + n[y]) // (p.num + p.den))
            left.append(x[ok])
            right.append(y[ok])
            step += 1
        pairs = _couples(doc, left, right)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _met(members: DataFrame, nodes: DataFrame, known: DataFrame, total: int, p: JaccardParams, steps: int) -> DataFrame:
    """Pairs (a, b) of members in different components that may link, as a written table."""
    lengths = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 2 * p.block_rows)
    if lengths.limit(p.broadcast_ids + 1).count() <= p.broadcast_ids:
        members = members.join(F.broadcast(lengths), "key", "left")
    else:
        members = salted_join(members, lengths, "key", "left", total)
    blocks = F.coalesce(F.expr(f"(m + {p.block_rows - 1}) div {p.block_rows}"), F.lit(1))
    placed = known.select(F.col("doc_id").alias("a"), "bits").join(nodes.withColumnRenamed("node", "a"), "a", "left")
    placed = placed.withColumn("component", F.coalesce("component", "a"))
    rows = salted_join(members.withColumn("blocks", blocks), placed, "a", total=total)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, cast(blocks as long) - 1L)")))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    parts = max(64, total // 100_000)
    alone = F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.lit(0))
    rows = rows.withColumns({"part": F.pmod("key", F.lit(parts)), "alone": alone})
    rows = rows.select("part", "alone", "lo", "hi", "own", "key", "a", "n", "pos", "small", "component", "bits")
    pairs = rows.groupBy("part", "alone", "lo", "hi").applyInPandas(_across(p, steps), "a long, b long")
    return materialise(pairs.distinct(), "jaccard-met")


# ---------------------------------------------------------------- verification


def _verify(p: JaccardParams):
    """mapInArrow: pairs with both texts, compressed, to the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.slice(start, 512)
                a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
                packed = list(dict.fromkeys([*x, *y]))
                of = dict(zip(packed, _bytes.shingles([unzip(z) for z in packed], p.words)))
                good = []
                for k in range(len(a)):
                    both = np.concatenate([of[x[k]], of[y[k]]])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if shared and p.den * shared >= p.num * (len(both) - shared):
                        good.append(k)
                if good:
                    yield pa.RecordBatch.from_pydict({"a": [a[k] for k in good], "b": [b[k] for k in good]})

    return run


def _verified(docs: DataFrame, pairs: DataFrame, p: JaccardParams) -> DataFrame:
    """The pairs (a, b) of a written table that reach the threshold, as a written table."""
    count = pairs.count()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    side = F.broadcast(wanted) if 2 * count <= p.broadcast_ids else wanted
    texts = zipped(docs.join(side, "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary").alias("text")), "text")
    texts = materialise(texts.where("text is not null"), "jaccard-texts")
    at = lambda end, text: texts.select(F.col("doc_id").alias(end), F.col("text").alias(text))
    one = salted_join(pairs.select("a", "b"), at("a", "x"), "a", total=count)
    both = salted_join(materialise(one, "jaccard-half"), at("b", "y"), "b", total=count)
    links = both.select("a", "b", "x", "y").mapInArrow(_verify(p), "a long, b long")
    return materialise(links.distinct(), "jaccard-links")


# ---------------------------------------------------------------- the join


def jaccard_components(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text)."""
    p = params
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    described = materialise(rows.mapInArrow(_described(p), "doc_id long, n long, sig binary, bits binary"), "jaccard-rows")
    known = described.where("doc_id is not null")
    # rows of one set: a class, known by its smallest doc_id
    classes = known.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"))
    total, words = described.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, counts = heavy_tokens(rows, p)
    frequent_from = max(p.frequent_least, total // p.frequent)
    heavy = spark.sparkContext.broadcast((tokens, counts))
    prefixes = rows.mapInArrow(
        _prefixes(p, heavy, frequent_from), "sig binary, doc_id long, n long, singles long, prefix binary"
    )
    reps = prefixes.groupBy("sig").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("singles").alias("singles"), F.first("prefix").alias("prefix")
    )
    bits = 8
    while (words // 5) >> bits > p.bucket_rows and bits < 40:
        bits += 1
    packed = reps.mapInArrow(_postings(p, bits, heavy), "bucket long, blob binary")
    found = materialise(
        packed.groupBy("bucket").applyInPandas(
            _candidates(p), "listed boolean, key long, a long, b long, n long, pos long, small boolean"
        ),
        "jaccard-candidates",
    )
    pairs = materialise(found.where("not listed").select("a", "b").distinct(), "jaccard-first")
    links = _verified(rows, pairs, p)
    # rows that repeat a doc_id tie their classes together
    several = known.where("n > 0").groupBy("doc_id").agg(F.min("sig").alias("x"), F.max("sig").alias("y")).where("x <> y")
    tied = (
        known.where("n > 0").join(several.select("doc_id"), "doc_id").join(classes, "sig")
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    )
    nodes = components(links.unionByName(tied))
    members = found.where("listed").select("key", "a", "n", "pos", "small")
    count = members.count()
    of_reps = materialise(classes.select(F.col("rep").alias("doc_id"), "bits"), "jaccard-bits")
    for steps in (p.steps, 0) if count else ():
        met = _met(members, nodes, of_reps, count, p, steps)
        if met.limit(1).count():
            more = _verified(rows, met, p)
            nodes = components(nodes.toDF("a", "b").unionByName(more))
    of_class = classes.join(nodes.withColumnRenamed("node", "rep"), "rep", "left").select(
        "sig", F.coalesce("component", "rep").alias("component_id")
    )
    return salted_join(described.select("doc_id", "n", "sig"), of_class, "sig", "left", total).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """The rows of docs that stand for their component, those of its smallest doc_id; rows without a doc_id all stay.

    Of rows that repeat that doc_id each distinct text stays once, in the row whose JSON hashes least.
    """
    judged = jaccard_components(docs, params).where("doc_id is not null")
    told = judged.groupBy(F.col("doc_id").alias("__id")).agg(
        F.max(F.col("component_id") < F.col("doc_id")).alias("__gone"), (F.count(F.lit(1)) > 1).alias("__many")
    )
    told = told.where("__gone or __many")
    mine = docs.where("doc_id is not null")
    rows = mine.join(told, mine["doc_id"] == told["__id"], "left").where("not coalesce(__gone, false)")
    same = W.partitionBy("doc_id", F.sha2("text", 256)).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    once = rows.where("__many").withColumn("__rank", F.row_number().over(same)).where("__rank = 1")
    kept = rows.where("__many is null").select(*docs.columns).unionByName(once.select(*docs.columns))
    return kept.unionByName(docs.where("doc_id is null"))
