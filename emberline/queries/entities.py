"""Names of the benchmark's passages found in the documents: a passage's first words name a character, the next ones others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities as N
from ..schema import Views
from .registry import query

_BREAKS = r"[\s,;.:!?\\/`()\[\]{}<>\"''’“”]+"
_STOP = ", ".join(f"'{w}'" for w in N.STOPWORDS)


def _chosen(n: int, before: str) -> str:
    """Of the hits of n words, from the left, those that use no word of the names chosen before or of one another."""
    return f"""h{n} as (select doc_id, i from hit h where len = {n} and not exists (select 1 from {before} p where p.doc_id = h.doc_id and p.i < h.i + {n} and h.i < p.i + p.len)),
p{n} as (select doc_id, unnest(list_reduce(list(list_value(i) order by i), lambda a, x: case when x[1] >= a[-1] + {n} then list_concat(a, x) else a end)) as i, {n} as len from h{n} group by doc_id)"""


@query("d3_entities", rf"""tok as (select doc_id, list_filter(string_split_regex(text, '{_BREAKS}'), lambda x: x <> '') as t from documents where text is not null),
bm as (select item_id, list_filter(string_split_regex(text, '{_BREAKS}'), lambda x: x <> '') as t from benchmark where text is not null),
nm as (select array_to_string(t[1:3], ' ') as name, item_id as id, 'character' as category from bm where len(t) >= 3
  union all select array_to_string(t[4:5], ' '), item_id + 1000000, 'corporation' from bm where len(t) >= 5
  union all select t[6], item_id + 2000000, 'alliance' from bm where len(t) >= 6),
best as (select key, unnest(e) from (select lower(name) as key, min({{'id': id, 'name': name, 'category': category}}) as e from nm group by 1)),
cand as (select doc_id, len, i, array_to_string(t[i + 1:i + len], ' ') as token from (select doc_id, t, len, unnest(range(0, greatest(len(t) - len + 1, 0))) as i from tok, (values (3), (2), (1)) l(len))),
hit as (select * from cand join best on lower(token) = key where lower(token) not in ({_STOP}) and (len > 1 or (length(token) >= 3 and not regexp_full_match(token, '[0-9]+')))),
none as (select -1 as doc_id, 0 as i, 0 as len where false),
{_chosen(3, "none")}, {_chosen(2, "p3")}, both_ as (select * from p3 union all select * from p2), {_chosen(1, "both_")},
picked as (select * from both_ union all select * from p1)
select doc_id as event_id, token, category as type, id, name, 'exact_name' as method, case when len > 1 then 'high' else 'medium' end as confidence, i as token_offset
from picked join hit using (doc_id, i, len)""")
def entities(v: Views) -> DataFrame:
    passages = v.table("benchmark").where("text is not null").select("item_id", N.words(F.col("text")).alias("t"))
    parts = ((1, 3, 0, "character"), (4, 2, 1_000_000, "corporation"), (6, 1, 2_000_000, "alliance"))
    named = [
        F.when(F.size("t") >= at + n - 1, F.struct(F.array_join(F.slice("t", at, n), " ").alias("name"), (F.col("item_id") + more).alias("entity_id"), F.lit(kind).alias("category")))
        for at, n, more, kind in parts
    ]
    names = passages.select(F.explode(F.array(*named)).alias("n")).where("n is not null").select("n.*")
    # No codes, said so that Catalyst knows it: it takes tables of unknown size for huge.
    systems = v.spark.range(0).where("false").select(F.lit("").alias("name"), "id")
    return N.resolve(v.table("documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("message")), names, systems)
