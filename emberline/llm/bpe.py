"""Byte-level BPE encoding and decoding with recursive DuckDB queries, one database per Python worker.

A text splits by the tokenizer's pattern. The distinct pieces of a batch that the worker hasn't met go to DuckDB as rows:
a recursive query joins each piece's neighbouring tokens, by position, with the merge table and contracts the leftmost
pair of minimum rank, until no pair of the piece is in the table. Decoding joins the tokens of each distinct id run with
the vocabulary and concatenates their bytes by an aggregation ordered by position. A document's ids and bytes are the
concatenation of its pieces'.

Pieces of more than `long_piece` bytes, on which one merge a round would be quadratic, are encoded by windows of `window`
bytes. Tokens are the encoding of their bytes if, and only if, every two neighbours are that of theirs: the first merge
across a border would also be made in the two tokens alone. So only the seams of windows are tested, as pairs; around
one that fails, some tokens on both sides are encoded anew, twice as many each round. Where such a stretch, as in text
that repeats itself, has more than `long_piece` bytes, a second recursion contracts a pair at all its places at once,
wherever no pair that such a contraction makes can rank before it; the order of the steps then makes no difference. The
worker remembers the pieces met last, up to twice `remembered`.

Defined cases: null text counts as empty; an empty text has no ids; repeated rows are encoded one by one; a text of any
length is encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class BpeParams:
    #: a rank file (base64 token, rank) and the pattern that splits text; rank files are read by the workers, where the
    #: tokenizer package is installed
    ranks: str
    pattern: str
    batch_chars: int = 2_000_000
    long_piece: int = 200
    window: int = 64
    remembered: int = 250_000
    #: pieces, and about so many bytes of them, contracted by one query
    query_pieces: int = 20_000
    query_bytes: int = 250_000


ENCODE = """
with recursive step(it, wid, toks) as (
  select 0, wid, list(tok order by pos) from piece_tokens group by wid
  union all
  select it + 1, wid, list_concat(list_concat(toks[:p0 - 1], [merged]), toks[p0 + 2:]) from (
    select any_value(it) as it, wid, any_value(toks) as toks, min(m) as merged, min(m * 1024 + p) % 1024 as p0 from (
      select it, wid, toks, p, m from (select it, wid, toks, unnest(range(1, len(toks))) as p from step)
      join merges on l = toks[p] and r = toks[p + 1])
    group by wid))
select wid, arg_max(toks, it) as ids from step group by wid order by wid
"""

#: The same for long pieces: of the places of the pair of least rank every second of adjoining ones, from the left, is
#: contracted; the first alone where the merged token may start or end a pair of smaller rank. Only a piece's last state
#: is kept.
ENCODE_LONG = """
with recursive step(wid, toks) using key (wid) as (
  select wid, list(tok order by pos) from piece_tokens group by wid
  union all
  select wid, list(case when start then least_m else tok end order by p) from (
    select *, coalesce(lag(start) over (partition by wid order by p), false) as used from (
      select *, m is not distinct from least_m and case when safe then (p - first) % 2 = 0 else p = leftmost end as start from (
        select *, min(p) over (partition by wid, hit, island) as first, min(case when hit then p end) over (partition by wid) as leftmost from (
          select *, p - row_number() over (partition by wid, hit order by p) as island from (
            select *, m is not distinct from least_m as hit from (
              select wid, p, tok, m, min(m) over (partition by wid) as least_m, arg_min(safe, m) over (partition by wid) as safe from (
                select wid, p, toks[p] as tok, toks[p + 1] as follows from (select wid, toks, unnest(range(1, len(toks) + 1)) as p from step)
              ) left join merges on l = tok and r = follows)
            where least_m is not null)))))
  where not used
  group by wid)
select wid, toks as ids from step order by wid
"""

DECODE = """
select rid, string_agg(bytes, '' order by pos) as bytes from id_runs join vocabulary using (tok) group by rid order by rid
"""


class Codec:
    """What a worker keeps: the merge table and the vocabulary in DuckDB, and the pieces met so far."""

    _by_params: dict = {}

    @classmethod
    def of(cls, params: BpeParams) -> Codec:
        if params not in cls._by_params:
            cls._by_params[params] = cls(params)
        return cls._by_params[params]

    def __init__(self, params: BpeParams):
        import duckdb
        import regex

        self.params = params
        self.split = regex.compile(params.pattern).findall
        with open(params.ranks, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        rows = [
            (self.ranks[t[:i]], self.ranks[t[i:]], n)
            for t, n in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        left, right, merged = (pa.array(x, pa.int32()) for x in zip(*rows))
        merges = pa.table({"l": left, "r": right, "m": merged})  # noqa: F841
        vocabulary = pa.table(  # noqa: F841
            {"tok": pa.array(self.ranks.values(), pa.int32()), "bytes": [t.hex() for t in self.ranks]}
        )
        self.db.execute("create table merges as select l, r, m::bigint as m from merges")
        self.db.execute(
            "alter table merges add column safe boolean; update merges set safe = m not in ("
            "select l from merges where m < l union all select r from merges where m < r)"
        )
        self.db.execute("create table vocabulary as select * from vocabulary")
        self.token_bytes = {n: t for t, n in self.ranks.items()}
        self.byte_ids = [self.ranks[bytes([i])] for i in range(256)]
        self.ids: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}

    def _contract(self, query: str, raw: list[bytes]) -> dict[bytes, bytes]:
        import numpy as np

        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        piece_tokens = pa.table(  # noqa: F841
            {
                "wid": np.repeat(np.arange(len(raw), dtype=np.int32), lengths),
                "pos": (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.int32),
                "tok": np.array(self.byte_ids, np.int32)[np.frombuffer(b"".join(raw), np.uint8)],
            }
        )
        ids = self.db.execute(query).to_arrow_table()["ids"].combine_chunks()
        values, offsets = ids.values.to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
        return {p: values[a:b] for p, a, b in zip(raw, offsets, offsets[1:])}

    def _encoded(self, raw: set[bytes]) -> dict[bytes, bytes]:
        """The ids of each byte string by the recursion for its length, some queries at a time."""
        out: dict[bytes, bytes] = {}
        most = self.params.long_piece
        for query, some in ((ENCODE, [b for b in raw if len(b) <= most]), (ENCODE_LONG, [b for b in raw if len(b) > most])):
            part: list[bytes] = []
            held = 0
            for b in some:
                part.append(b)
                held += len(b)
                if len(part) >= self.params.query_pieces or held >= self.params.query_bytes:
                    out |= self._contract(query, part)
                    part, held = [], 0
            if part:
                out |= self._contract(query, part)
        return out

    def _stitched(self, raw: list[bytes]) -> dict[bytes, bytes]:
        """The ids of long byte strings: windows, whose seams are tested and mended until all hold."""
        import numpy as np

        w, of = self.params.window, self.token_bytes
        cut = [[b[i : i + w] for i in range(0, len(b), w)] for b in raw]
        ids = self._encoded({x for parts in cut for x in parts})
        tokens = [np.frombuffer(b"".join(map(ids.__getitem__, parts)), "<u4") for parts in cut]
        seams = [(np.cumsum([len(ids[x]) for x in parts])[:-1] // 4).tolist() for parts in cut]
        sound: dict[tuple[int, int], bool] = {}
        reach = 4
        while any(seams):
            beside = [[(int(t[s - 1]), int(t[s])) for s in at] for t, at in zip(tokens, seams)]
            new = {x for xs in beside for x in xs} - sound.keys()
            alone = self._encoded({of[a] + of[b] for a, b in new})
            sound |= {(a, b): alone[of[a] + of[b]] == a.to_bytes(4, "little") + b.to_bytes(4, "little") for a, b in new}
            stretches: list[list[list]] = []
            for t, at, xs in zip(tokens, seams, beside):
                found: list[list] = []
                for s, x in zip(at, xs):
                    if sound[x]:
                        continue
                    lo, hi = max(0, s - reach), min(len(t), s + reach)
                    if found and lo <= found[-1][1]:
                        found[-1][1] = hi
                    else:
                        found.append([lo, hi])
                stretches.append([[lo, hi, b"".join(of[x] for x in t[lo:hi])] for lo, hi in found])
            again = self._encoded({x[2] for found in stretches for x in found})
            for n, found in enumerate(stretches):
                t, parts, here, last, seams[n] = tokens[n], [], 0, 0, []
                for lo, hi, text in found:
                    mended = np.frombuffer(again[text], "<u4")
                    here += lo - last
                    ends = [here] * (lo > 0) + [here + len(mended)] * (hi < len(t))
                    parts += [t[last:lo], mended]
                    here += len(mended)
                    last = hi
                    seams[n] += ends
                tokens[n] = np.concatenate([*parts, t[last:]])
            reach *= 2
        return {b: t.tobytes() for b, t in zip(raw, tokens)}

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces not met lately, and decodes their ids."""
        import numpy as np

        known, former = self.ids, self.former
        fresh: dict[str, bytes] = {}
        short: list[bytes] = []
        long_ones: list[bytes] = []
        for p in pieces:
            if p in known:
                continue
            if (ids := former.get(p)) is not None:
                known[p] = ids
                continue
            b = p.encode()
            if (whole := self.ranks.get(b)) is not None:
                fresh[p] = whole.to_bytes(4, "little")
            else:
                (long_ones if len(b) > self.params.long_piece else short).append(b)
        for ids in (self._encoded({*short}), self._stitched(long_ones)):
            fresh |= {b.decode(): x for b, x in ids.items()}
        known.update(fresh)
        runs = [r for r in {*fresh.values()} if r not in self.decoded]
        if runs:
            flat = np.frombuffer(b"".join(runs), "<u4").astype(np.int32)
            lengths = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
            ends = np.cumsum(lengths)
            id_runs = pa.table(  # noqa: F841
                {
                    "rid": np.repeat(np.arange(len(runs), dtype=np.int32), lengths),
                    "pos": (np.arange(len(flat)) - np.repeat(ends - lengths, lengths)).astype(np.int32),
                    "tok": flat,
                }
            )
            out = self.db.execute(DECODE).to_arrow_table()["bytes"].to_pylist()
            self.decoded.update(zip(runs, map(bytes.fromhex, out)))

    def forget(self) -> None:
        """Pieces that come often are met again before they have grown old twice."""
        if len(self.ids) > self.params.remembered:
            self.former, self.ids = self.ids, {}
            kept = set(self.former.values())
            self.decoded = {ids: b for ids, b in self.decoded.items() if ids in kept}


def _row(codec: Codec, words: list[str], want_ids: bool, want_bytes: bool) -> tuple:
    runs = list(map(codec.ids.__getitem__, words))
    ids = b"".join(runs)
    back = b"".join(map(codec.decoded.__getitem__, runs))
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), ids if want_ids else None, back if want_bytes else None


def encode_decode(docs: DataFrame, params: BpeParams, keep_ids: bool = False, zipped: bool = False, keep_bytes: bool = True) -> DataFrame:
    """All columns of docs but text, plus n_tokens, ids_sha256 and decoded_sha256, and with keep_ids token_ids and,
    unless keep_bytes is off, decoded.

    Added columns replace columns of the same name. zipped: text is zstd-compressed UTF-8, read as it is encoded.
    """
    added = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if keep_ids:
        added += [T.StructField("token_ids", T.ArrayType(T.LongType()))]
        added += [T.StructField("decoded", T.BinaryType())] if keep_bytes else []
    taken = {"text"} | {f.name.lower() for f in added}
    carried = [c for c in docs.columns if c.lower() not in taken]
    schema = T.StructType([docs.schema[c] for c in carried] + added)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        codec = Codec.of(params)
        unzip = zstandard.ZstdDecompressor().decompress

        def flush(part: pa.RecordBatch, words: list[list[str]]) -> pa.RecordBatch:
            codec.forget()
            pieces: set[str] = set()
            for w in words:
                pieces.update(w)
            codec.learn(pieces)
            rows = [_row(codec, w, keep_ids, keep_ids and keep_bytes) for w in words]
            columns = [part.column(c) for c in carried] + [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.string()),
            ]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(r[3], "<u4").astype(np.int64) for r in rows], pa.list_(pa.int64())))
                if keep_bytes:
                    columns.append(pa.array([r[4] for r in rows], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

        for batch in batches:
            texts = batch.column("text")
            words: list[list[str]] = []
            start = chars = 0
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                if zipped and text:
                    text = unzip(text).decode()
                words.append(codec.split(text))
                chars += len(text)
                if chars >= params.batch_chars:
                    yield flush(batch.slice(start, i + 1 - start), words)
                    start, chars, words = i + 1, 0, []
            if words:
                yield flush(batch.slice(start), words)

    return docs.select(*carried, "text").mapInArrow(blocks, schema)
