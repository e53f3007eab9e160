"""From documents to the digest graph: sentences, fragments, chunks, edges, weights, incisions.

The model that would extract chunks is replaced by a rule in whole numbers, so
every later operator has data at any scale. Each step is a DataFrame; SQL holds
the same steps as common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import once, table

#: Weights of the attributes, and the least weight of an edge.
RETENTION = {"verbatim": 27, "detailed": 9, "focused": 3, "relevant": 1}
IMPORTANCE = {"critical": 9, "important": 3, "helpful": 1}
LEAST_EDGE = 0.1
GROUP_WORDS, SNAKE_WORDS = 3840, 280
#: A chunk's id is its serial's times WIDE plus its number. A text has at most 2**31 bytes, so its numbers are smaller; a product beyond 64 bits is an error, not a wrong id.
WIDE = 1_000_000_000


def fragments(docs: DataFrame) -> DataFrame:
    """serial_id, sidx, fragment_id, sentence_index, text, words: sentences packed into fragments of at most FRAGMENT_WORDS. One row is one task's work; nothing is shuffled."""
    made = docs.select(F.col("doc_id").alias("serial_id"), T.sentences(F.col("text")).alias("s"))
    made = made.select("serial_id", F.arrays_zip("s", T.packed(F.transform("s", lambda x: x["words"]), T.FRAGMENT_WORDS).alias("b")).alias("x"))
    rows = made.select("serial_id", F.posexplode("x").alias("sidx", "x"))
    return rows.select("serial_id", F.col("sidx").cast("long").alias("sidx"), F.col("x.b.bin").alias("fragment_id"), F.col("x.b.at").alias("sentence_index"), F.col("x.s.text").alias("text"), F.col("x.s.words").alias("words"))


def chunk_rule(sents: DataFrame) -> DataFrame:
    k = F.expr("sidx div 3")
    ret = F.element_at(F.array(*map(F.lit, RETENTION), F.lit(None)), ((F.col("words") + F.col("sidx")) % 5 + 1).cast("int"))
    imp = F.element_at(F.array(*map(F.lit, IMPORTANCE), F.lit(None)), ((F.col("words") * 7 + F.col("sidx")) % 4 + 1).cast("int"))
    return sents.where("sidx % 3 = 0").select((F.col("serial_id") * WIDE + k + 1).alias("id"), "serial_id", "fragment_id", "sentence_index", k.alias("k"), "words", ret.alias("retention"), imp.alias("importance"), F.substring("text", 1, 24).alias("label"), "text")


def edge_rule(chunks: DataFrame) -> DataFrame:
    """Links to the chunk before and to one further back: an equi-join on (serial, k), each chunk asking for at most two."""
    back = F.array_distinct(F.array(F.col("k") - 1, F.col("k") - 2 - F.col("words") % 7))
    strength = F.element_at(F.array(*map(F.lit, IMPORTANCE), F.lit(None)), ((F.col("k") + F.col("words")) % 4 + 1).cast("int"))
    asks = chunks.select("serial_id", F.col("id").alias("from_id"), F.explode(back).alias("k"), strength.alias("strength"))
    return asks.join(chunks.select("serial_id", "k", F.col("id").alias("to_id")), ["serial_id", "k"]).select("serial_id", "from_id", "to_id", "strength")


def rank_of(col: str, values: dict[str, int], default: int = 0):
    out = F.lit(default)
    for name, v in values.items():
        out = F.when(F.col(col) == name, F.lit(v)).otherwise(out)
    return out


def chunk_weights(chunks: DataFrame) -> DataFrame:
    """A1: what retention and importance weigh together."""
    return chunks.withColumn("weight", (rank_of("retention", RETENTION) + rank_of("importance", IMPORTANCE)).cast("double"))


def edge_weights(weighted: DataFrame, edges: DataFrame) -> DataFrame:
    """A2 and A3: each end's weight is shared among its edges by strength; an edge gets both shares, at least LEAST_EDGE."""
    e = edges.withColumn("s", rank_of("strength", IMPORTANCE, 1).cast("double"))
    ends = e.select(F.col("from_id").alias("id"), "s").unionByName(e.select(F.col("to_id").alias("id"), "s"))
    per = ends.groupBy("id").agg(F.sum("s").alias("total")).join(weighted.select("id", "weight"), "id").select("id", (F.col("weight") / F.col("total")).alias("rate"))
    out = e.join(per.select(F.col("id").alias("from_id"), F.col("rate").alias("rf")), "from_id").join(per.select(F.col("id").alias("to_id"), F.col("rate").alias("rt")), "to_id")
    return out.select("serial_id", "from_id", "to_id", "strength", F.greatest(F.col("rf") * F.col("s") + F.col("rt") * F.col("s"), F.lit(LEAST_EDGE)).alias("weight"))


def incisions(weighted: DataFrame, edges: DataFrame, sents: DataFrame) -> DataFrame:
    """A chunk's weight is shared among its edges that leave its fragment; shares to earlier fragments cut at the start, others at the end. Rounded to 9 places, since what follows has steps."""
    c = weighted.select("id", "serial_id", "fragment_id", "weight")
    both = edges.select("from_id", "to_id", F.col("weight").alias("w"))
    both = both.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "w").unionByName(both.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "w"))
    far = both.join(c, "id").join(c.select(F.col("id").alias("other"), F.col("fragment_id").alias("of")), "other").where("of <> fragment_id")
    per = far.groupBy("id", "serial_id", "fragment_id", "weight").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("of") < F.col("fragment_id"), F.col("w")).otherwise(0.0)).alias("before"), F.sum(F.when(F.col("of") > F.col("fragment_id"), F.col("w")).otherwise(0.0)).alias("after"))
    share = per.where("total > 0").groupBy("serial_id", "fragment_id").agg(F.sum(F.col("weight") / F.col("total") * F.col("before")).alias("s"), F.sum(F.col("weight") / F.col("total") * F.col("after")).alias("e"))
    words = sents.groupBy("serial_id", "fragment_id").agg(F.sum("words").alias("words_count"))
    every = c.select("serial_id", "fragment_id").distinct().join(words, ["serial_id", "fragment_id"], "left").join(share, ["serial_id", "fragment_id"], "left")
    return every.select("serial_id", "fragment_id", F.coalesce("words_count", F.lit(0)).cast("long").alias("words_count"), F.round(F.coalesce("s", F.lit(0.0)), 9).alias("start_incision"), F.round(F.coalesce("e", F.lit(0.0)), 9).alias("end_incision"))


def normalized(infos: DataFrame) -> DataFrame:
    """Per serial, values from the 98th percentile on score 10, the others from 1 to 10 on a logarithmic scale, 0 stays 0."""
    each = infos.select("serial_id", F.explode(F.array("start_incision", "end_incision")).alias("v")).where("v > 0")
    place = Window.partitionBy("serial_id")
    ranked = each.withColumn("n", F.count("*").over(place)).withColumn("r", F.row_number().over(place.orderBy("v")))
    cut = ranked.where("r = least(floor(n * 0.98), n - 1) + 1").select("serial_id", F.col("v").alias("threshold"))
    low = each.join(cut, "serial_id").where("v < threshold").groupBy("serial_id").agg(F.log(F.min("v")).alias("lo"), F.log(F.max("v")).alias("hi"))
    wide = infos.join(cut, "serial_id", "left").join(low, "serial_id", "left")

    def scale(name: str):
        v = F.col(name)
        span = F.when(F.col("hi") - F.col("lo") == 0, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
        step = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.round(1 + (F.log(v) - F.col("lo")) / span * 9 + 0.5, 9)).cast("int")))
        return F.when(v == 0, 0).when(F.col("lo").isNull() | (v >= F.col("threshold")), 10).otherwise(step).cast("int").alias(name)

    return wide.select("serial_id", "fragment_id", "words_count", scale("start_incision"), scale("end_incision"))


class Digest:
    """The tables of one folder, each written when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _once(self, name: str, make) -> DataFrame:
        return once(self.spark, self.sf_dir, name, make)

    @property
    def docs(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "documents")

    @property
    def fsent(self) -> DataFrame:
        return self._once("fsent", lambda: fragments(self.docs.select("doc_id", "text")))

    @property
    def chunks(self) -> DataFrame:
        return self._once("chunks", lambda: chunk_weights(chunk_rule(self.fsent)))

    @property
    def raw_edges(self) -> DataFrame:
        return self._once("raw_edges", lambda: edge_rule(self.chunks))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: edge_weights(self.chunks, self.raw_edges))

    @property
    def infos(self) -> DataFrame:
        return self._once("infos", lambda: incisions(self.chunks, self.edges, self.fsent))

    @property
    def scored(self) -> DataFrame:
        return self._once("scored", lambda: normalized(self.infos))

    @property
    def groups(self) -> DataFrame:
        """Plain packing of fragments in order, closing at the limit (W6); the incision-guided split is operators.grouping."""
        listed = self.infos.groupBy("serial_id").agg(F.sort_array(F.collect_list(F.struct("fragment_id", "words_count"))).alias("f"))
        return listed.select("serial_id", F.explode(F.arrays_zip(F.col("f.fragment_id").alias("f"), T.packed(F.col("f.words_count"), GROUP_WORDS, True).alias("b"))).alias("x")).select("serial_id", F.col("x.b.bin").alias("group_id"), F.col("x.f").alias("fragment_id"))


#: name -> (names it needs, SQL). DuckDB: integer division is //.
_rank = lambda c, values, default=0: f"case {c} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {default} end"
_pick = lambda e, n, values: f"case {e} % {n} " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(values)) + " end"
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "sent": ((), rf"select doc_id serial_id, row_number() over (partition by doc_id order by pos) - 1 sidx, t as text, len(regexp_extract_all(t, '{T.WORD}'))::bigint words from (select doc_id, trim(unnest(x)) t, unnest(range(1, len(x) + 1)) pos from (select doc_id, regexp_extract_all(coalesce(text, ''), '{T.SENTENCE}') x from documents)) where t <> ''"),
    "pack": (("sent",), f"select serial_id, sidx, 0::bigint frag, words cur from sent where sidx = 0 union all select s.serial_id, s.sidx, case when p.cur > 0 and p.cur + s.words > {T.FRAGMENT_WORDS} then p.frag + 1 else p.frag end, case when p.cur > 0 and p.cur + s.words > {T.FRAGMENT_WORDS} then s.words else p.cur + s.words end from pack p join sent s on s.serial_id = p.serial_id and s.sidx = p.sidx + 1"),
    "fsent": (("sent", "pack"), "select serial_id, sidx, frag fragment_id, sidx - min(sidx) over (partition by serial_id, frag) sentence_index, text, words from sent join pack using (serial_id, sidx)"),
    "chunks": (("fsent",), f"select *, ({_rank('retention', RETENTION)} + {_rank('importance', IMPORTANCE)})::double weight from (select serial_id * {WIDE} + sidx // 3 + 1 id, serial_id, fragment_id, sentence_index, sidx // 3 k, words, {_pick('(words + sidx)', 5, RETENTION)} retention, {_pick('(words * 7 + sidx)', 4, IMPORTANCE)} importance, substr(text, 1, 24) as label, text from fsent where sidx % 3 = 0)"),
    "raw_edges": (("chunks",), f"select a.serial_id, a.id from_id, b.id to_id, {_pick('(a.k + a.words)', 4, IMPORTANCE)} strength from chunks a join chunks b on a.serial_id = b.serial_id and (b.k = a.k - 1 or b.k = a.k - 2 - a.words % 7)"),
    "es": (("raw_edges",), f"select *, ({_rank('strength', IMPORTANCE, 1)})::double s from raw_edges"),
    "rate": (("es", "chunks"), "select id, weight / total rate from (select id, sum(s) total from (select from_id id, s from es union all select to_id, s from es) group by id) join chunks using (id)"),
    "edges": (("es", "rate"), f"select e.serial_id, e.from_id, e.to_id, e.strength, greatest(f.rate * e.s + t.rate * e.s, {LEAST_EDGE}::double) weight from es e join rate f on f.id = e.from_id join rate t on t.id = e.to_id"),
    "far": (("edges", "chunks"), "select c.id, c.serial_id, c.fragment_id, c.weight, o.fragment_id ofr, x.w from (select from_id id, to_id other, weight w from edges union all select to_id, from_id, weight from edges) x join chunks c on c.id = x.id join chunks o on o.id = x.other where o.fragment_id <> c.fragment_id"),
    "per": (("far",), "select id, serial_id, fragment_id, weight, sum(w) total, sum(case when ofr < fragment_id then w else 0 end) b, sum(case when ofr > fragment_id then w else 0 end) a from far group by all"),
    "infos": (("per", "chunks", "fsent"), "select serial_id, fragment_id, coalesce(any_value(w), 0)::bigint words_count, round(coalesce(any_value(s), 0), 9) start_incision, round(coalesce(any_value(e), 0), 9) end_incision from chunks left join (select serial_id, fragment_id, sum(words) w from fsent group by all) using (serial_id, fragment_id) left join (select serial_id, fragment_id, sum(weight / total * b) s, sum(weight / total * a) e from per where total > 0 group by all) using (serial_id, fragment_id) group by serial_id, fragment_id"),
    "incv": (("infos",), "select serial_id, unnest([start_incision, end_incision]) v from infos"),
    "thr": (("incv",), "select serial_id, v threshold from (select serial_id, v, row_number() over (partition by serial_id order by v) r, count(*) over (partition by serial_id) n from incv where v > 0) where r = least(floor(n * 0.98), n - 1) + 1"),
    "logs": (("incv", "thr"), "select serial_id, ln(min(v)) lo, ln(max(v)) hi from incv join thr using (serial_id) where v > 0 and v < threshold group by serial_id"),
    "scored": (("infos", "thr", "logs"), "select serial_id, fragment_id, words_count, " + ", ".join(f"(case when {c} = 0 then 0 when lo is null or {c} >= threshold then 10 else greatest(1, least(10, floor(round(1 + (ln(case when {c} > 0 then {c} else 1 end) - lo) / (case when hi - lo = 0 then 1 else hi - lo end) * 9 + 0.5, 9)))) end)::int {c}" for c in ("start_incision", "end_incision")) + " from infos left join thr using (serial_id) left join logs using (serial_id)"),
    "ford": (("infos",), "select serial_id, fragment_id, words_count, row_number() over (partition by serial_id order by fragment_id) r from infos"),
    "gpack": (("ford",), f"select serial_id, fragment_id, r, 0::bigint g, words_count cur from ford where r = 1 union all select f.serial_id, f.fragment_id, f.r, case when p.cur + f.words_count > {GROUP_WORDS} or p.cur >= {GROUP_WORDS} then p.g + 1 else p.g end, case when p.cur + f.words_count > {GROUP_WORDS} or p.cur >= {GROUP_WORDS} then f.words_count else p.cur + f.words_count end from gpack p join ford f on f.serial_id = p.serial_id and f.r = p.r + 1"),
    "groups": (("gpack",), "select serial_id, g group_id, fragment_id from gpack"),
}


def sql(body: str, *names: str) -> str:
    """``body`` after the table expressions that it names and those that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in CTES[name][0]:
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    recursive = ("pack", "gpack")
    return "with recursive " + ",\n".join(f"{n} as {'' if n in recursive else 'materialized '}({CTES[n][1]})" for n in order) + f"\n{body}"
