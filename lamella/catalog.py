"""The queries of the library: name -> (DataFrame, SQL). SQL is None where only a loop expresses the operator."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import language
from .functions import similarity as S
from .functions import text as T
from .operators import editor, evidence, graph, grouping, model, store
from .plans import digest
from .plans.digest import WIDE, Digest, sql
from .session import table
from .sinks import export
from .sources import archive, epub, plain
from .streaming.packer import pack_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def entry(name: str, oracle: str | None = None):
    def put(fn: Callable[[Digest], DataFrame]) -> Callable[[Digest], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Digest(spark, sf_dir))
        if oracle:
            SQL[name] = oracle
        return fn

    return put


def on(name: str, oracle: str | None = None):
    """A query over plain tables."""

    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda t: table(spark, sf_dir, t))
        if oracle:
            SQL[name] = oracle
        return fn

    return put


def simple(name: str, names: str, body: str, fn: Callable[[Digest], DataFrame]) -> None:
    entry(name, sql(body, *names.split()))(fn)


col, lit = F.col, F.lit

# --- text ---------------------------------------------------------------------------------------------------------
simple("txt_sentences", "sent", "select serial_id, sidx, text, words from sent", lambda d: d.fsent.select("serial_id", "sidx", "text", "words"))
simple("txt_fragments", "fsent", "select serial_id, fragment_id, string_agg(text, ' ' order by sidx) as text, sum(words)::bigint words from fsent group by all",
       lambda d: d.fsent.groupBy("serial_id", "fragment_id").agg(F.array_join(store.ordered(col("text"), "sidx"), " ").alias("text"), F.sum("words").alias("words")))
simple("txt_discovery", "fsent", "select serial_id, (max(fragment_id) + 1)::bigint fragments, sum(words)::bigint words from fsent group by serial_id",
       lambda d: d.fsent.groupBy("serial_id").agg((F.max("fragment_id") + 1).alias("fragments"), F.sum("words").alias("words")))
simple("txt_boundaries", "sent", "select serial_id, min(sidx)::bigint lo, max(sidx)::bigint hi, arg_min(text, sidx) head, arg_max(text, sidx) tail from sent group by serial_id",
       lambda d: d.fsent.groupBy("serial_id").agg(F.min("sidx").alias("lo"), F.max("sidx").alias("hi"), F.min_by("text", "sidx").alias("head"), F.max_by("text", "sidx").alias("tail")))
on("txt_normalize_ascii", "select item_id, lower(regexp_replace(text, '[^0-9A-Za-z]+', '', 'g')) norm from benchmark")(lambda t: t("benchmark").select("item_id", T.ascii_normal(col("text")).alias("norm")))
on("txt_collapse_truncate", r"select doc_id, case when c = '' then '(none)' when length(c) > 80 then substr(c, 1, 80) || '...' else c end as short from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) c from documents)")(
    lambda t: t("documents").select("doc_id", T.truncate(col("text")).alias("short")))
on("txt_paragraphs", r"select doc_id, len(p)::bigint n, coalesce(len(p[1]), 0)::bigint first_chars from (select doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s*\n\s*', ' ', 'g'))), lambda x: x <> '') p from documents)")(
    lambda t: t("documents").select("doc_id", T.let(T.paragraphs(col("text")), lambda p: F.struct(F.size(p).cast("long").alias("n"), F.coalesce(F.char_length(F.get(p, lit(0))), lit(0)).cast("long").alias("first_chars"))).alias("p")).select("doc_id", "p.*"))
on("txt_xml_escape", """select page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as url from pages""")(lambda t: t("pages").select("page_id", T.xml_escape(col("url")).alias("url")))
on("txt_language_code", "select doc_id, coalesce(nullif(trim(case when doc_id % 7 = 0 then ' ' else lang end), ''), 'und') lang from documents")(
    lambda t: t("documents").select("doc_id", T.language_code(F.when(col("doc_id") % 7 == 0, " ").otherwise(col("lang"))).alias("lang")))
_tagged = "'<chunk label=\"x\" retention=\"verbatim\">' || text || '</chunk> end'"
on("txt_strip_tags", f"select item_id, replace(regexp_replace({_tagged}, '<chunk(?:\\s+[^>]*)?>', '', 'g'), '</chunk>', '') as text from benchmark")(
    lambda t: t("benchmark").select("item_id", T.strip_chunk_tags(F.concat(lit('<chunk label="x" retention="verbatim">'), col("text"), lit("</chunk> end"))).alias("text")))
on("txt_compressed_section", r"select item_id, trim(regexp_extract('thoughts' || chr(10) || '## Compressed Text' || chr(10) || text || chr(10) || '---' || chr(10) || 'x', '(?is)##\s*(?:Compressed\s+Text|压缩文本)\s*\n+(.*?)(?:\n+---|\*\*CRITICAL\*\*|\z)', 1)) body, 'thoughts' as thinking from benchmark")(
    lambda t: t("benchmark").withColumn("r", F.concat(lit("thoughts\n## Compressed Text\n"), col("text"), lit("\n---\nx"))).select("item_id", T.compressed_text(col("r")).alias("body"), T.thinking_text(col("r")).alias("thinking")))
on("txt_json_extract", "select event_id, props as json from events")(
    lambda t: t("events").select("event_id", T.json_text(F.concat(lit("Here it is:\n```json\n"), col("props"), lit("\n```\n"))).alias("json")))
on("txt_title_fallback", "select c_custkey, coalesce(nullif(trim(case when c_custkey % 3 = 0 then '' else c_name end), ''), nullif(trim(case when c_custkey % 2 = 0 then c_mktsegment end), ''), 'Section ' || (c_custkey // 10 + 1) || '.' || (c_custkey % 10 + 1)) title from customer")(
    lambda t: t("customer").select("c_custkey", F.coalesce(F.nullif(F.trim(F.when(col("c_custkey") % 3 == 0, "").otherwise(col("c_name"))), lit("")), F.nullif(F.trim(F.when(col("c_custkey") % 2 == 0, col("c_mktsegment"))), lit("")), F.concat(lit("Section "), F.expr("c_custkey div 10 + 1"), lit("."), col("c_custkey") % 10 + 1)).alias("title")))

# --- similarity -----------------------------------------------------------------------------------------------------
_PAIR = "(select a.item_id, lower(a.text) x, lower(b.text) y from benchmark a join benchmark b on b.item_id = a.item_id + 1)"
_G = lambda v, n: f"case when {v} = '' then [] when length({v}) <= {n} then [{v}] else list_distinct(list_transform(range(1, length({v}) - {n} + 2), lambda i: substr({v}, i, {n}))) end"
_D = lambda a, b: f"(case when len({a}) = 0 or len({b}) = 0 then 0 else 2.0::double * len(list_intersect({a}, {b})) / (len({a}) + len({b})) end)"


def _pairs(t) -> DataFrame:
    """Every item with the next, whole texts."""
    b = t("benchmark")
    return b.select("item_id", F.lower("text").alias("x")).join(b.select((col("item_id") - 1).alias("item_id"), F.lower("text").alias("y")), "item_id")


_NG = f"select item_id, x, y, {_G('x', 2)} x2, {_G('y', 2)} y2, {_G('x', 3)} x3, {_G('y', 3)} y3 from {_PAIR}"
on("sim_ngrams", f"select item_id, len(x2)::int n2, len(y3)::int n3, round({_D('x2', 'y2')}, 6) dice, round(({_D('x2', 'y2')} + {_D('x3', 'y3')}) / 2, 6) score from ({_NG})")(
    lambda t: _pairs(t).select("item_id", F.size(S.ngrams(col("x"), 2)).alias("n2"), F.size(S.ngrams(col("y"), 3)).alias("n3"), F.round(S.dice(S.ngrams(col("x"), 2), S.ngrams(col("y"), 2)), 6).alias("dice"), F.round(S.ngram_score(col("x"), col("y")), 6).alias("score")))
#: DuckDB measures bytes: letters beyond ASCII become control characters there, one each, which keeps the distance.
_LETTERS = "éèêëàâäçîïôöùûüñßíóáúìòœæ"
_BYTES = " || ".join(f"chr({k})" for k in range(1, len(_LETTERS) + 1))
_PLAIN = f"(select item_id, translate(x, '{_LETTERS}', {_BYTES}) x, translate(y, '{_LETTERS}', {_BYTES}) y from {_PAIR})"
on("sim_edit", f"select item_id, round(1 - levenshtein(x, y)::double / greatest(length(x), length(y)), 6) edit, round(1 - abs(length(x) - length(y))::double / greatest(length(x), length(y)), 6) len_sim from {_PLAIN}")(
    lambda t: _pairs(t).select("item_id", F.round(S.edit_similarity(col("x"), col("y")), 6).alias("edit"), F.round(S.length_similarity(col("x"), col("y")), 6).alias("len_sim")))
on("sim_char_jaccard", f"select item_id, round(len(list_intersect(a, b))::double / greatest(1, len(list_distinct(a || b))), 6) j from (select item_id, list_distinct(list_filter(string_split(x, ''), lambda c: c <> '')) a, list_distinct(list_filter(string_split(y, ''), lambda c: c <> '')) b from {_PAIR})")(
    lambda t: _pairs(t).select("item_id", F.round(S.char_jaccard(col("x"), col("y")), 6).alias("j")))
# a common substring of length n has a run of n equal characters on one diagonal of the two texts
on("sim_common_substring", f"""with p as materialized (select item_id, x, y from {_PAIR}), c as materialized (select item_id, i, unnest(range(1, length(y) + 1)) j, x, y from (select item_id, x, y, unnest(range(1, length(x) + 1)) i from p)),
m as (select item_id, i - j as diag, i, i - row_number() over (partition by item_id, i - j order by i) run from c where substr(x, i, 1) = substr(y, j, 1)),
l as (select item_id, max(n) n from (select item_id, count(*) n from m group by item_id, diag, run) group by item_id)
select item_id, round(2.0::double * coalesce(n, 0) / (length(x) + length(y)), 6) ratio from p left join l using (item_id)""")(
    lambda t: _pairs(t).select("item_id", F.round(S.common_substring_ratio(col("x"), col("y")), 6).alias("ratio")))
_SPACED = "' ' || trim(regexp_replace(lower({}), '[^0-9a-z]+', ' ', 'g')) || ' '"
on("sim_contained", f"""select doc_id, item_id, round(case when trim(q) = trim(c) then 1 when nq = nc then 0.995 else least(1, 0.75 + 0.25 * length(nq)::double / length(nc) + case when length(nq) >= 12 and strpos(nc, nq) = 1 then 0.08 * (0.5 + 0.5 * least(1, length(nq)::double / length(nc))) else 0 end) end, 6)::double score
from (select doc_id, item_id, d.text c, b.text q, lower(regexp_replace(d.text, '[^0-9A-Za-z]+', '', 'g')) nc, lower(regexp_replace(b.text, '[^0-9A-Za-z]+', '', 'g')) nq from (select *, {_SPACED.format("text")} s from documents) d join (select *, {_SPACED.format("text")} s from benchmark) b on contains(d.s, b.s) where b.s <> '  ')""")(
    lambda t: _contained(t("documents").select("doc_id", "text"), t("benchmark").select("item_id", "text")))


def _contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Items whose words stand in a document one after the other, with their score. They meet by the item's first words, at most HEAD of them; a document's words are hashed in windows as long."""
    heads = 4
    said = lambda x: F.array_remove(F.split(F.lower(x), "[^0-9a-z]+"), "")
    spaced = lambda w: F.concat(lit(" "), F.array_join(w, " "), lit(" "))
    q = items.select("item_id", col("text").alias("q"), said(col("text")).alias("w")).where(F.size("w") > 0).select("item_id", "q", spaced(col("w")).alias("qs"), F.xxhash64(F.slice("w", 1, heads)).alias("h"), F.least(F.size("w"), lit(heads)).alias("len"))
    window = lambda w, n: F.transform(F.when(F.size(w) >= n, F.sequence(lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(w, i, n)))
    d = docs.select("doc_id", "text", F.explode(T.let(said(F.coalesce("text", lit(""))), lambda w: F.array_distinct(F.concat(*[window(w, n) for n in range(1, heads + 1)])))).alias("h"))
    both = d.join(q, "h").dropDuplicates(["doc_id", "item_id", "text"]).where(F.contains(spaced(said(col("text"))), col("qs")))
    return both.select("doc_id", "item_id", F.round(S.contained_score(col("q"), col("text"), T.ascii_normal(col("q")), T.ascii_normal(col("text")), "start_anchor"), 6).cast("double").alias("score"))


_QUOTES = "(select doc_id, item_id, q, c, lower(regexp_replace(q, '[^0-9A-Za-z]+', '', 'g')) nq, lower(regexp_replace(c, '[^0-9A-Za-z]+', '', 'g')) nc from (select d.doc_id, b.item_id, substr(b.text, 1, 20) q, substr(d.text, 1, 120) c from documents d join benchmark b on d.doc_id % 20 = b.item_id % 20 where d.lang = 'en'))"
simple("sim_rank", "fsent", "select serial_id, sidx, rank, prev_text, next_text from (select serial_id, sidx, row_number() over (partition by serial_id order by least(words, 20) desc, (length(text) > 40) desc, sidx) as rank, lag(text, 1, '') over (partition by serial_id order by sidx) prev_text, lead(text, 1, '') over (partition by serial_id order by sidx) next_text from fsent) where rank <= 3",
       lambda d: d.fsent.withColumn("prev_text", F.lag("text", 1, "").over(Window.partitionBy("serial_id").orderBy("sidx"))).withColumn("next_text", F.lead("text", 1, "").over(Window.partitionBy("serial_id").orderBy("sidx")))
       .withColumn("rank", store.number(F.least("words", lit(20)).desc(), (F.char_length("text") > 40).desc(), "sidx", within=("serial_id",))).where("rank <= 3").select("serial_id", "sidx", "rank", "prev_text", "next_text"))
simple("sim_sentence_index", "fsent", f"select text, count(*)::bigint n, min(serial_id * {WIDE} + sidx)::bigint first_id from fsent group by text having count(*) > 1",
       lambda d: d.fsent.groupBy("text").agg(F.count("*").alias("n"), F.min(col("serial_id") * WIDE + col("sidx")).alias("first_id")).where("n > 1"))
simple("sim_chunk_words", "fsent chunks", "select c.id, sum(s.words)::bigint words from chunks c join fsent s on s.serial_id = c.serial_id and s.fragment_id = c.fragment_id and s.sentence_index between c.sentence_index and c.sentence_index + 2 group by c.id",
       lambda d: d.chunks.select("id", "serial_id", "fragment_id", F.explode(F.sequence(col("sentence_index"), col("sentence_index") + 2)).alias("sentence_index")).join(d.fsent.select("serial_id", "fragment_id", "sentence_index", "words"), ["serial_id", "fragment_id", "sentence_index"]).groupBy("id").agg(F.sum("words").alias("words")))
simple("sim_range", "fsent", "select serial_id, s.sidx start_at, e.sidx end_at, (e.sidx - s.sidx + 1)::bigint n from (select serial_id, min(sidx) sidx from fsent where words >= 12 group by all) s join (select serial_id, max(sidx) sidx from fsent where words >= 12 group by all) e using (serial_id) where e.sidx >= s.sidx",
       lambda d: d.fsent.where("words >= 12").groupBy("serial_id").agg(F.min("sidx").alias("start_at"), F.max("sidx").alias("end_at")).withColumn("n", col("end_at") - col("start_at") + 1))

# --- store ----------------------------------------------------------------------------------------------------------
on("st_serials_ensure", "select o_custkey id from (select distinct o_custkey from orders) union select c_custkey from customer")(
    lambda t: store.insert_absent(t("orders").select(col("o_custkey").alias("id")).distinct(), t("customer").select(col("c_custkey").alias("id")), "id"))
on("st_serials_get", "select c_custkey id, coalesce(o_custkey is not null, false) ready from customer left join (select distinct o_custkey from orders) on o_custkey = c_custkey where c_custkey <= 100")(
    lambda t: t("customer").where("c_custkey <= 100").select(col("c_custkey").alias("id")).join(t("orders").select(col("o_custkey").alias("id"), lit(True).alias("r")).distinct(), "id", "left").select("id", F.coalesce("r", lit(False)).alias("ready")))
on("st_serials_max", "select coalesce(max(c_custkey), 0)::bigint id, (select coalesce(max(c_custkey), 0)::bigint from customer where c_custkey < 0) none from customer")(
    lambda t: t("customer").agg(F.coalesce(F.max("c_custkey"), lit(0)).cast("long").alias("id"), F.coalesce(F.max(F.when(col("c_custkey") < 0, col("c_custkey"))), lit(0)).cast("long").alias("none")))
on("st_serials_ready", "select c_custkey id, c_custkey % 5 = 0 or c_custkey in (select o_custkey from orders where o_totalprice > 100000) ready from customer")(
    lambda t: t("customer").select(col("c_custkey").alias("id")).join(t("orders").where("o_totalprice > 100000").select(col("o_custkey").alias("id"), lit(True).alias("r")).distinct(), "id", "left").select("id", ((col("id") % 5 == 0) | F.coalesce("r", lit(False))).alias("ready")))
simple("st_serials_list", "chunks", "select distinct serial_id id from chunks", lambda d: d.chunks.select(col("serial_id").alias("id")).distinct().orderBy("id"))
_CHUNK = ["id", "serial_id", "fragment_id", "sentence_index", "words", "retention", "importance", "weight"]
_C = ", ".join(_CHUNK)
simple("st_chunks_save", "chunks", f"select {_C} from chunks where id % 3 <> 0 union all select id, serial_id, fragment_id, sentence_index, words + 1, retention, 'critical', weight + 1 from chunks where id % 3 = 0",
       lambda d: store.upsert(d.chunks.select(*_CHUNK), d.chunks.where("id % 3 = 0").select("id", "serial_id", "fragment_id", "sentence_index", (col("words") + 1).alias("words"), "retention", lit("critical").alias("importance"), (col("weight") + 1).alias("weight"), lit(2).alias("seq")).unionByName(d.chunks.where("id % 3 = 0").select(*_CHUNK, lit(1).alias("seq"))), "id"))
simple("st_chunks_get", "chunks", f"select {_C} from chunks where id in (1, {WIDE + 1}, {2 * WIDE + 2})", lambda d: d.chunks.where(col("id").isin(1, WIDE + 1, 2 * WIDE + 2)).select(*_CHUNK))
simple("st_chunks_all", "chunks", f"select {_C} from chunks", lambda d: d.chunks.select(*_CHUNK).orderBy("id"))
simple("st_chunks_by_fragments", "chunks", f"select {_C} from chunks where serial_id = 7 and fragment_id in (0, 2)", lambda d: d.chunks.where((col("serial_id") == 7) & col("fragment_id").isin(0, 2)).select(*_CHUNK).orderBy("id"))
simple("st_chunks_by_serial", "chunks", f"select {_C} from chunks where serial_id = 11", lambda d: d.chunks.where("serial_id = 11").select(*_CHUNK).orderBy("id"))
simple("st_chunks_max", "chunks", "select coalesce(max(id), 0)::bigint id from chunks", lambda d: d.chunks.agg(F.coalesce(F.max("id"), lit(0)).alias("id")))
simple("st_fragment_pairs", "chunks", "select distinct serial_id, fragment_id from chunks", lambda d: d.chunks.select("serial_id", "fragment_id").distinct().orderBy("serial_id", "fragment_id"))
simple("st_chunk_children", "chunks fsent", "select c.id, string_agg(s.sentence_index::varchar, ',' order by s.sentence_index) kids from chunks c join fsent s on s.serial_id = c.serial_id and s.fragment_id = c.fragment_id and s.sentence_index in (c.sentence_index, c.sentence_index + 1) group by c.id",
       lambda d: d.chunks.select("id", "serial_id", "fragment_id", F.explode(F.array(col("sentence_index"), col("sentence_index") + 1)).alias("sentence_index")).join(d.fsent.select("serial_id", "fragment_id", "sentence_index"), ["serial_id", "fragment_id", "sentence_index"]).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("sentence_index")), lambda x: x.cast("string")), ",").alias("kids")))
_EDGE = ["from_id", "to_id", "strength", "weight"]
_E = "from_id, to_id, strength, round(weight, 6) weight"
_edge = lambda e: e.select("from_id", "to_id", "strength", F.round("weight", 6).alias("weight"))
simple("st_edges_save", "edges", "select from_id, to_id, case when from_id % 4 = 0 then 'helpful' else strength end strength, round(case when from_id % 4 = 0 then 1 else weight end, 6) weight from edges",
       lambda d: _edge(store.upsert(d.edges.select(*_EDGE), d.edges.where("from_id % 4 = 0").select("from_id", "to_id", lit("helpful").alias("strength"), lit(1.0).alias("weight"), lit(1).alias("seq")), "from_id", "to_id")))
simple("st_edges_all", "edges", f"select {_E} from edges", lambda d: _edge(d.edges).orderBy("from_id", "to_id"))
simple("st_edges_by_serial", "edges chunks", f"select {_E.replace('weight, 6', 'e.weight, 6')} from edges e join chunks a on a.id = e.from_id join chunks b on b.id = e.to_id where a.serial_id = 5 and b.serial_id = 5",
       lambda d: _edge(store.within(d.edges, d.chunks.where("serial_id = 5"), "from_id", "to_id")))
simple("st_edges_incoming", "edges", f"select {_E} from edges where to_id = {8 * WIDE + 3}", lambda d: _edge(d.edges.where(col("to_id") == 8 * WIDE + 3)))
simple("st_edges_outgoing", "edges", f"select {_E} from edges where from_id = {8 * WIDE + 9}", lambda d: _edge(d.edges.where(col("from_id") == 8 * WIDE + 9)))
simple("st_edges_within", "edges", f"select {_E} from edges where from_id % 2 = 0 and to_id % 2 = 0", lambda d: _edge(store.within(d.edges, d.chunks.where("id % 2 = 0"), "from_id", "to_id")))
simple("st_groups_list", "groups", "select group_id, fragment_id from groups where serial_id = 3", lambda d: d.groups.where("serial_id = 3").select("group_id", "fragment_id").orderBy("group_id", "fragment_id"))
simple("st_groups_serials", "groups", "select distinct serial_id from groups", lambda d: d.groups.select("serial_id").distinct().orderBy("serial_id"))
simple("st_groups_ids", "groups", "select distinct serial_id, group_id from groups", lambda d: d.groups.select("serial_id", "group_id").distinct())
simple("st_groups_save", "groups", "select serial_id, case when fragment_id = 0 then 0 else group_id + 1 end group_id, fragment_id from groups",
       lambda d: store.upsert(d.groups, d.groups.where("fragment_id > 0").select("serial_id", (col("group_id") + 1).alias("group_id"), "fragment_id", lit(1).alias("seq")), "serial_id", "fragment_id"))
simple("st_fragment_sentence", "fsent", "select serial_id, fragment_id, text from fsent where sentence_index = 1", lambda d: d.fsent.where("sentence_index = 1").select("serial_id", "fragment_id", "text"))
simple("st_fragment_words", "fsent", "select serial_id, fragment_id, sum(words)::bigint words from fsent group by all", lambda d: d.fsent.groupBy("serial_id", "fragment_id").agg(F.sum("words").alias("words")))
# --- joins ----------------------------------------------------------------------------------------------------------
simple("j_endpoint_weights", "edges chunks", "select e.from_id, e.to_id, f.weight wf, t.weight wt from edges e join chunks f on f.id = e.from_id join chunks t on t.id = e.to_id",
       lambda d: d.edges.select("from_id", "to_id").join(d.chunks.select(col("id").alias("from_id"), col("weight").alias("wf")), "from_id").join(d.chunks.select(col("id").alias("to_id"), col("weight").alias("wt")), "to_id"))
_far = lambda d: d.edges.select("from_id", "to_id", "weight").join(d.chunks.select(col("id").alias("from_id"), col("fragment_id").alias("ff")), "from_id").join(d.chunks.select(col("id").alias("to_id"), col("fragment_id").alias("tf")), "to_id")
simple("j_other_fragment", "edges chunks", "select e.from_id, e.to_id, f.fragment_id ff, t.fragment_id tf from edges e join chunks f on f.id = e.from_id join chunks t on t.id = e.to_id where f.fragment_id <> t.fragment_id", lambda d: _far(d).where("ff <> tf").select("from_id", "to_id", "ff", "tf"))
simple("j_chunk_group", "chunks groups", "select id, group_id from chunks join groups using (serial_id, fragment_id)", lambda d: d.chunks.join(d.groups, ["serial_id", "fragment_id"]).select("id", "group_id"))


def _grouped(d: Digest, most: int = 400) -> DataFrame:
    """Groups of one fragment each four: small enough that links cross them."""
    return d.infos.select("serial_id", "fragment_id", F.expr("fragment_id div 2").alias("group_id"))


_GRP = "(select serial_id, fragment_id, fragment_id // 2 group_id from infos)"
_CG = f"(select c.*, g.group_id from chunks c join {_GRP} g using (serial_id, fragment_id))"


def _chunk_groups(d: Digest) -> DataFrame:
    return d.chunks.join(_grouped(d), ["serial_id", "fragment_id"])


def _within_groups(d: Digest) -> DataFrame:
    c = _chunk_groups(d)
    return d.edges.join(c.select(col("id").alias("from_id"), col("group_id").alias("fg")), "from_id").join(c.select(col("id").alias("to_id"), col("group_id").alias("tg")), "to_id").where("fg = tg")


simple("j_within_group", "edges chunks infos", f"select e.from_id, e.to_id, a.group_id from edges e join {_CG} a on a.id = e.from_id join {_CG} b on b.id = e.to_id where a.group_id = b.group_id", lambda d: _within_groups(d).select("from_id", "to_id", col("fg").alias("group_id")))
simple("j_cover", "fsent chunks", "select s.serial_id, s.sidx, count(c.id)::bigint n from fsent s left join chunks c on c.serial_id = s.serial_id and c.fragment_id = s.fragment_id and c.sentence_index = s.sentence_index group by all",
       lambda d: d.fsent.join(d.chunks.select("serial_id", "fragment_id", "sentence_index", "id"), ["serial_id", "fragment_id", "sentence_index"], "left").groupBy("serial_id", "sidx").agg(F.count("id").alias("n")))
on("j_toc_summary", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")(lambda t: t("orders").join(t("customer"), col("o_custkey") == col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.raise_error(lit("missing summary"))).alias("c_name")))
simple("j_reference", "chunks", "select c.id, coalesce(n.id, t.id) target from chunks c left join chunks n on c.id % 2 = 0 and n.id = c.id - 1 left join chunks t on c.id % 2 = 1 and t.serial_id = c.serial_id and t.label = c.label and t.k = 0 where coalesce(n.id, t.id) is not null",
       lambda d: d.chunks.select("id", "serial_id", "label").join(d.chunks.select((col("id") + 1).alias("id"), col("id").alias("n")).where("id % 2 = 0"), "id", "left").join(d.chunks.where("k = 0").select("serial_id", "label", col("id").alias("t")), ["serial_id", "label"], "left").select("id", F.coalesce("n", F.when(col("id") % 2 == 1, col("t"))).alias("target")).where("target is not null"))
simple("j_history", "chunks", "select serial_id, id from chunks where (serial_id, fragment_id) not in (select serial_id, max(fragment_id) from chunks group by 1)",
       lambda d: d.chunks.join(d.chunks.groupBy("serial_id").agg(F.max("fragment_id").alias("fragment_id")), ["serial_id", "fragment_id"], "left_anti").select("serial_id", "id"))
simple("j_from_start", "fsent", "select serial_id, count(*)::bigint n from fsent s join (select serial_id, min(sidx) st from fsent where words >= 10 group by 1) using (serial_id) where sidx >= st group by 1",
       lambda d: d.fsent.join(d.fsent.where("words >= 10").groupBy("serial_id").agg(F.min("sidx").alias("st")), "serial_id").where("sidx >= st").groupBy("serial_id").agg(F.count("*").alias("n")))

# --- aggregates -----------------------------------------------------------------------------------------------------
simple("a_chunk_weight", "chunks", "select id, weight from chunks", lambda d: d.chunks.select("id", "weight"))
simple("a_strength_total", "es", "select id, sum(s) total from (select from_id id, s from es union all select to_id, s from es) group by id",
       lambda d: d.raw_edges.withColumn("s", digest.rank_of("strength", digest.IMPORTANCE, 1).cast("double")).select(F.explode(F.array("from_id", "to_id")).alias("id"), "s").groupBy("id").agg(F.sum("s").alias("total")))
simple("a_edge_weight", "edges", "select from_id, to_id, round(weight, 6) weight from edges", lambda d: d.edges.select("from_id", "to_id", F.round("weight", 6).alias("weight")))
simple("a_external_weight", "per", "select id, round(total, 6) total from per", lambda d: _far(d).where("ff <> tf").select(F.explode(F.array("from_id", "to_id")).alias("id"), "weight").groupBy("id").agg(F.round(F.sum("weight"), 6).alias("total")))
simple("a_incision", "infos", "select serial_id, fragment_id, words_count, round(start_incision, 6) s, round(end_incision, 6) e from infos", lambda d: d.infos.select("serial_id", "fragment_id", "words_count", F.round("start_incision", 6).alias("s"), F.round("end_incision", 6).alias("e")))
simple("a_threshold", "thr", "select serial_id, round(threshold, 6) threshold from thr",
       lambda d: d.infos.select("serial_id", F.explode(F.array("start_incision", "end_incision")).alias("v")).where("v > 0").groupBy("serial_id").agg(F.sort_array(F.collect_list("v")).alias("x")).select("serial_id", F.round(F.element_at("x", F.least(F.floor(F.size("x") * 0.98), F.size("x") - 1).cast("int") + 1), 6).alias("threshold")))
simple("a_normalized", "scored", "select * from scored", lambda d: d.scored)
simple("a_best_marks", "chunks", "select serial_id, fragment_id, arg_max(id, (case retention when 'verbatim' then 4 when 'detailed' then 3 when 'focused' then 2 when 'relevant' then 1 else 0 end) * 1000000000000000000 - id) r, arg_max(id, (case importance when 'critical' then 3 when 'important' then 2 when 'helpful' then 1 else 0 end) * 1000000000000000000 - id) i from chunks group by all",
       lambda d: d.chunks.groupBy("serial_id", "fragment_id").agg(F.max_by("id", F.struct(digest.rank_of("retention", {"verbatim": 4, "detailed": 3, "focused": 2, "relevant": 1}), -col("id"))).alias("r"), F.max_by("id", F.struct(digest.rank_of("importance", {"critical": 3, "important": 2, "helpful": 1}), -col("id"))).alias("i")))
simple("a_clue_weight", "chunks", "select id, case when sum(weight) over (partition by serial_id) = 0 then 0 else round(weight / sum(weight) over (partition by serial_id), 6) end w from chunks",
       lambda d: d.chunks.select("id", F.sum("weight").over(Window.partitionBy("serial_id")).alias("t"), "weight").select("id", F.when(col("t") == 0, 0.0).otherwise(F.round(col("weight") / col("t"), 6)).alias("w")))
simple("a_fragments_per_group", "chunks infos", f"select serial_id, group_id, string_agg(distinct fragment_id::varchar, ',' order by fragment_id::varchar) f from {_CG} group by all", lambda d: _chunk_groups(d).groupBy("serial_id", "group_id").agg(F.array_join(F.sort_array(F.collect_set(col("fragment_id").cast("string"))), ",").alias("f")))
simple("a_fragment_count", "fsent", "select serial_id, count(distinct fragment_id)::bigint n from fsent group by 1", lambda d: d.fsent.select("serial_id", "fragment_id").distinct().groupBy("serial_id").agg(F.count("*").alias("n")))
simple("a_totals", "fsent", "select count(distinct serial_id)::bigint serials, count(*)::bigint sentences, sum(words)::bigint words, sum((sentence_index = 0)::int)::bigint fragments from fsent",
       lambda d: d.fsent.agg(F.countDistinct("serial_id").alias("serials"), F.count("*").alias("sentences"), F.sum("words").alias("words"), F.sum((col("sentence_index") == 0).cast("long")).alias("fragments")))
simple("a_progress", "fsent", "select serial_id, fragment_id, (sum(w) over (partition by serial_id order by fragment_id))::bigint done, greatest((sum(w) over (partition by serial_id order by fragment_id)), 300)::bigint total from (select serial_id, fragment_id, sum(words) w from fsent group by all)",
       lambda d: d.fsent.groupBy("serial_id", "fragment_id").agg(F.sum("words").alias("w")).withColumn("done", F.sum("w").over(Window.partitionBy("serial_id").orderBy("fragment_id"))).select("serial_id", "fragment_id", "done", F.greatest("done", lit(300)).cast("long").alias("total")))

# --- windows, sorts, sets ---------------------------------------------------------------------------------------------
simple("w_neighbours", "fsent", "select serial_id, sidx, lag(words, 1, 0) over w p, lead(words, 1, 0) over w n from fsent window w as (partition by serial_id order by sidx)",
       lambda d: d.fsent.select("serial_id", "sidx", F.lag("words", 1, 0).over(Window.partitionBy("serial_id").orderBy("sidx")).alias("p"), F.lead("words", 1, 0).over(Window.partitionBy("serial_id").orderBy("sidx")).alias("n")))
simple("w_position", "chunks", "select id, row_number() over (partition by serial_id, fragment_id order by sentence_index, id) - 1 as position from chunks", lambda d: d.chunks.select("id", (store.number("sentence_index", "id", within=("serial_id", "fragment_id")) - 1).alias("position")))
_isl = "select serial_id, fragment_id, sentence_index, m, sum(case when m is not distinct from p and m is not null then 0 else 1 end) over (partition by serial_id, fragment_id order by sentence_index) island from (select *, lag(m) over (partition by serial_id, fragment_id order by sentence_index) p from (select serial_id, fragment_id, sentence_index, case words % 3 when 0 then 'a' when 1 then 'b' end m from fsent))"
simple("w_islands", "fsent", f"select serial_id, fragment_id, island::bigint island, min(sentence_index)::bigint first_at, count(*)::bigint n, any_value(m) mark from ({_isl}) group by serial_id, fragment_id, island",
       lambda d: d.fsent.select("serial_id", "fragment_id", "sentence_index", F.when(col("words") % 3 == 0, "a").when(col("words") % 3 == 1, "b").alias("m")).withColumn("p", F.lag("m").over(Window.partitionBy("serial_id", "fragment_id").orderBy("sentence_index")))
       .withColumn("island", F.sum(F.when(col("m").isNotNull() & col("m").eqNullSafe(col("p")), 0).otherwise(1)).over(Window.partitionBy("serial_id", "fragment_id").orderBy("sentence_index"))).groupBy("serial_id", "fragment_id", "island").agg(F.min("sentence_index").alias("first_at"), F.count("*").alias("n"), F.first("m").alias("mark")))
simple("w_boundary", "infos", "select serial_id, fragment_id, round(end_incision + lead(start_incision) over w, 6) b, (sum(words_count) over w)::bigint upto from infos window w as (partition by serial_id order by fragment_id)",
       lambda d: d.infos.select("serial_id", "fragment_id", F.round(col("end_incision") + F.lead("start_incision").over(Window.partitionBy("serial_id").orderBy("fragment_id")), 6).alias("b"), F.sum("words_count").over(Window.partitionBy("serial_id").orderBy("fragment_id")).alias("upto")))
simple("w_greedy_groups", "groups", "select serial_id, group_id, fragment_id from groups", lambda d: d.groups.select("serial_id", "group_id", "fragment_id"))
simple("w_decayed_top", "chunks", "select serial_id, id, r from (select serial_id, id, row_number() over (partition by serial_id order by round(weight * pow(0.5, fragment_id), 9) desc, id) r from chunks) where r <= 7",
       lambda d: d.chunks.select("serial_id", "id", store.number(F.round(col("weight") * F.pow(lit(0.5), col("fragment_id")), 9).desc(), "id", within=("serial_id",)).alias("r")).where("r <= 7"))
simple("w_sentence_order", "chunks", "select id, row_number() over (partition by serial_id order by fragment_id, sentence_index, id) as at from chunks", lambda d: d.chunks.select("id", store.number("fragment_id", "sentence_index", "id", within=("serial_id",)).alias("at")))
on("s_top3", "select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber) r from lineitem) where r <= 3")(
    lambda t: t("lineitem").withColumn("r", store.number(col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", within=("l_partkey",))).where("r <= 3").select("l_partkey", "l_orderkey", "l_linenumber"))
simple("s_recent", "chunks", "select id, fragment_id from chunks order by fragment_id desc, id limit 7", lambda d: d.chunks.select("id", "fragment_id").orderBy(col("fragment_id").desc(), "id").limit(7))
simple("s_first", "chunks", "select id from chunks order by id limit 7", lambda d: d.chunks.select("id").orderBy("id").limit(7))
simple("s_light", "chunks", "select serial_id, id from (select serial_id, id, row_number() over (partition by serial_id order by weight desc, id) r from chunks) where r > 7",
       lambda d: d.chunks.select("serial_id", "id", store.number(col("weight").desc(), "id", within=("serial_id",)).alias("r")).where("r > 7").select("serial_id", "id"))
on("s_difference", "select c_custkey id from customer where c_custkey not in (select o_custkey from orders) union all select s_suppkey from supplier")(
    lambda t: t("customer").join(t("orders"), col("c_custkey") == col("o_custkey"), "left_anti").select(col("c_custkey").alias("id")).unionByName(t("supplier").select(col("s_suppkey").alias("id"))))
simple("s_ordered_distinct", "fsent", "select serial_id, words, min(sidx)::bigint as at from fsent group by all", lambda d: d.fsent.groupBy("serial_id", "words").agg(F.min("sidx").alias("at")))

# --- graph ----------------------------------------------------------------------------------------------------------
# links between neighbours are cut at some chunks, so that serials fall apart into several components
_CUTE = "(select e.from_id, e.to_id from raw_edges e join chunks c on c.id = e.from_id where (c.words + c.k) % 5 <> 0)"


def _cut_edges(d: Digest) -> DataFrame:
    return d.raw_edges.join(d.chunks.select(col("id").alias("from_id"), "k", "words"), "from_id").where("(words + k) % 5 <> 0").select("from_id", "to_id", "strength")


SQL["g_components"] = sql("select id, min(o)::bigint component from reach group by id", "raw_edges").replace("\nselect id, min", f",\nboth_ways as materialized (select from_id a, to_id b from {_CUTE} union all select to_id, from_id from {_CUTE}),\nreach as (select id, id o from chunks union select b.b, r.o from reach r join both_ways b on b.a = r.id)\nselect id, min")
QUERIES["g_components"] = lambda spark, sf_dir: (lambda d: graph.connected(d.chunks.select("id"), _cut_edges(d)))(Digest(spark, sf_dir))
simple("g_successors", "raw_edges", "select from_id id, string_agg(distinct to_id::varchar, ',' order by to_id::varchar) after_ids from raw_edges group by from_id", lambda d: d.raw_edges.groupBy(col("from_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set(col("to_id").cast("string"))), ",").alias("after_ids")))
simple("g_links", "raw_edges", "select greatest(from_id, to_id) from_id, least(from_id, to_id) to_id, count(*)::bigint n from (select from_id, to_id from raw_edges union all select to_id, from_id from raw_edges where from_id % 2 = 0) group by 1, 2",
       lambda d: d.raw_edges.select("from_id", "to_id").unionByName(d.raw_edges.where("from_id % 2 = 0").select(col("to_id").alias("from_id"), col("from_id").alias("to_id"))).groupBy(F.greatest("from_id", "to_id").alias("from_id"), F.least("from_id", "to_id").alias("to_id")).agg(F.count("*").alias("n")))
simple("g_small_components", "chunks", f"select serial_id, sum(words)::bigint words, sum(words) <= {digest.SNAKE_WORDS} small from chunks group by 1", lambda d: d.chunks.groupBy("serial_id").agg(F.sum("words").alias("words")).withColumn("small", col("words") <= digest.SNAKE_WORDS))
on("g_annotations", "select d.doc_id, coalesce(case l.quality when 1 then 'critical' when 0 then 'helpful' end, case when d.n_chars % 2 = 0 then 'important' end) importance from documents d left join labels l using (doc_id)")(
    lambda t: t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left").select("doc_id", F.coalesce(F.when(col("quality") == 1, "critical").when(col("quality") == 0, "helpful"), F.when(col("n_chars") % 2 == 0, "important")).alias("importance")))


def _snake_sql() -> str:
    """Snakes stand in as runs of four chunks of a group, so that the snake graph has SQL."""
    return f"(select *, (row_number() over (partition by serial_id, group_id order by fragment_id, sentence_index, id) - 1) // 4 sn from {_CG})"


def _runs(d: Digest) -> DataFrame:
    return _chunk_groups(d).withColumn("p", store.number("fragment_id", "sentence_index", "id", within=("serial_id", "group_id")) - 1).withColumn("sn", F.expr("p div 4"))


simple("g_snake_totals", "chunks infos", f"select serial_id, group_id, sn, count(*)::bigint size, sum(words)::bigint words, sum(weight) weight, arg_min(label, id) first_label, arg_max(label, id) last_label from {_snake_sql()} group by all",
       lambda d: _runs(d).groupBy("serial_id", "group_id", "sn").agg(F.count("*").alias("size"), F.sum("words").alias("words"), F.sum("weight").alias("weight"), F.min_by("label", "id").alias("first_label"), F.max_by("label", "id").alias("last_label")))
simple("g_snake_graph", "edges chunks infos", f"select a.serial_id, a.group_id, least(a.sn, b.sn) f, greatest(a.sn, b.sn) t, round(sum(e.weight), 6) weight from edges e join {_snake_sql()} a on a.id = e.from_id join {_snake_sql()} b on b.id = e.to_id where a.group_id = b.group_id and a.sn <> b.sn group by all",
       lambda d: (lambda s: d.edges.select("from_id", "to_id", "weight").join(s.select(col("id").alias("from_id"), "serial_id", "group_id", col("sn").alias("x")), "from_id").join(s.select(col("id").alias("to_id"), col("group_id").alias("g2"), col("sn").alias("y")), "to_id").where("group_id = g2 and x <> y")
       .groupBy("serial_id", "group_id", F.least("x", "y").alias("f"), F.greatest("x", "y").alias("t")).agg(F.round(F.sum("weight"), 6).alias("weight")))(_runs(d).select("id", "serial_id", "group_id", "sn")))
entry("g_fragment_groups")(lambda d: grouping.fragment_groups(d.scored, 600))
entry("g_snakes")(lambda d: graph.snakes(d.chunks, _cut_edges(d), grouping.fragment_groups(d.scored)))
entry("g_reflection")(lambda d: graph.attention(d.chunks, d.raw_edges))


def _clues(d: Digest) -> DataFrame:
    members = graph.snakes(d.chunks, _cut_edges(d), grouping.fragment_groups(d.scored))
    return grouping.clues(members.withColumn("snake_id", col("group_id") * WIDE + col("local_snake_id")), d.chunks)


entry("g_clues")(_clues)

# --- sources and model plumbing that are plain columns --------------------------------------------------------------------
on("l_sampling", "select l_orderkey, l_linenumber, round(case when l_linenumber >= 5 then 0.8 else 0.2 + (0.8 - 0.2) * least(1, l_linenumber / 5.0::double) end, 6)::double temperature from lineitem")(
    lambda t: t("lineitem").select("l_orderkey", "l_linenumber", F.round(0.2 + (0.8 - 0.2) * F.least(lit(1.0), col("l_linenumber") / 5.0), 6).alias("temperature")))
on("l_message_key")(lambda t: t("conversations").select("conv_id", "turn", model.key_column(col("text"), col("role")).alias("cache_key")))
on("l_context", "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as context, count(*)::bigint turns from conversations group by conv_id")(
    lambda t: t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], lit(": "), x["text"])), "\n").alias("context"), F.count("*").alias("turns")))
simple("l_summary", "fsent", "select serial_id, string_agg(t, chr(10) || chr(10) order by fragment_id) as summary from (select serial_id, fragment_id, trim(arg_min(text, sidx)) t from fsent group by all) where t <> '' group by serial_id",
       lambda d: d.fsent.groupBy("serial_id", "fragment_id").agg(F.trim(F.min_by("text", "sidx")).alias("t")).where("t <> ''").groupBy("serial_id").agg(F.array_join(store.ordered(col("t"), "fragment_id"), "\n\n").alias("summary")))
simple("snk_listing", "fsent", "select serial_id, 'Section ' || (serial_id + 1) || ': ' || count(distinct fragment_id) || ' fragments, ' || sum(words) || ' words' as line from fsent group by serial_id",
       lambda d: d.fsent.groupBy("serial_id").agg(F.concat(lit("Section "), col("serial_id") + 1, lit(": "), F.countDistinct("fragment_id"), lit(" fragments, "), F.sum("words"), lit(" words")).alias("line")))

# --- operators that are plain functions of one row: the query calls the function itself -----------------------------------


def through(fn, kind: str):
    """A column function that calls ``fn`` with the values of each row."""
    return F.pandas_udf(lambda *columns: pd.Series([fn(*x) for x in zip(*columns, strict=True)], dtype=object), kind)


_PATH = "rtrim('/', split_part(split_part(url, '?', 1), '#', 1))"
_DPATH = "rtrim(split_part(split_part(url, '?', 1), '#', 1), '/')"
on("src_metadata", f"select page_id, nullif(trim(regexp_extract({_DPATH}, '([^/.]*)(?:\\.[^/.]*)?$', 1)), '') stem from pages")(
    lambda t: t("pages").select("page_id", through(lambda x: plain.metadata(x, "txt")["title"], "string")(F.expr(_PATH)).alias("stem")))
_SUFFIX = "case page_id % 4 when 0 then '.epub' when 1 then '.MD' when 2 then '.txt' else '.markdown' end"
on("src_format", f"select page_id, case page_id % 4 when 0 then 'epub' when 2 then 'txt' else 'markdown' end as fmt from pages")(
    lambda t: t("pages").select("page_id", through(plain.infer_format, "string")(F.expr(f"{_PATH} || {_SUFFIX}")).alias("fmt")))
on("src_section_ids", "select page_id, h || case when r > 1 then '~' || r else '' end id from (select page_id, h, row_number() over (partition by h order by page_id) r from (select page_id, regexp_extract(url, '//([^/]*)', 1) h from pages))")(
    lambda t: t("pages").groupBy(F.regexp_extract("url", "//([^/]*)", 1).alias("h")).agg(F.sort_array(F.collect_list("page_id")).alias("p")).select("p", through(lambda h, p: epub.unique([h] * len(p)), "array<string>")("h", "p").alias("i")).select(F.explode(F.arrays_zip("p", "i")).alias("x")).select(col("x.p").alias("page_id"), col("x.i").alias("id")))
_CLOSE = "|".join(sorted(epub.BLOCKS))
on("src_html_text", rf"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>', '', 'g'), '(?i)<br[^>]*>|</({_CLOSE})>', ' ', 'g'), '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) as text from (select page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '&amp$', '&'), '(?s)<!--.*?-->', '', 'g'), '(?is)<head>.*?</head>', '', 'g'), '&amp;', '&'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&quot;', '"') html from pages)""")(
    lambda t: t("pages").select("page_id", F.regexp_replace(through(lambda x: None if x is None else epub.page_text(x), "string")("html"), r"[\s\u00a0]+", " ").alias("text")))
on("src_non_content", f"select page_id from pages where not regexp_matches(lower({_DPATH}), '/(toc|nav|contents|tableofcontents|cover|titlepage)\\.x?html$')")(
    lambda t: t("pages").where(~through(lambda x: bool(epub.NAMES.search(x)), "boolean")(F.expr(_PATH))).select("page_id"))
# files of even fragments as an object with a summary, the others as the older bare list
simple("src_fragment_json", "fsent", "select serial_id, fragment_id, count(*)::bigint n, sum(words)::bigint words, case when fragment_id % 2 = 0 then 's' else '' end as summary from fsent group by all",
       lambda d: _fragment_files(d))


def _fragment_files(d: Digest) -> DataFrame:
    files = d.fsent.groupBy("serial_id", "fragment_id").agg(F.sort_array(F.collect_list(F.struct("sidx", "text", col("words").alias("wordsCount")))).alias("s"))
    file = F.when(col("fragment_id") % 2 == 0, F.to_json(F.struct(lit("s").alias("summary"), col("s").alias("sentences")))).otherwise(F.to_json("s"))

    def read(x: str) -> str:
        f = archive.fragment(x)
        return f"{len(f['sentences'])} {sum(y['wordsCount'] for y in f['sentences'])} {f['summary']}"

    said = F.split(through(read, "string")(file), " ")
    return files.select("serial_id", "fragment_id", said.alias("x")).select("serial_id", "fragment_id", col("x")[0].cast("long").alias("n"), col("x")[1].cast("long").alias("words"), col("x")[2].alias("summary"))


on("l_cache_key")(lambda t: t("conversations").select("conv_id", "turn", through(lambda role, text: model.cache_key([{"role": role, "content": text}], "m1", "p1", 0.5), "string")("role", "text").alias("cache_key")))


def _validated(d: Digest) -> DataFrame:
    """Each chunk as a batch of its own with a link to the chunk before; every fifth has lost its label, every seventh its content, every eleventh its evidence."""

    def issues(i, label, content, quote, text):
        batch = {"chunks": [{"label": label, "content": content, "evidence": {"start_anchor": quote}}], "links": [{"from": "t0", "to": int(i) - 1}]}
        return "; ".join(model.validate_batch(batch, {int(i) - 1} if i % 2 else set(), [text]))

    lost = lambda n, x: F.when(col("id") % n == 0, "").otherwise(x)
    return d.chunks.select("id", through(issues, "string")("id", lost(5, col("label")), lost(7, col("text")), lost(11, col("text")), "text").alias("problem"))


simple("l_validation", "chunks", """select id, array_to_string(list_filter([case when id % 5 = 0 or trim(label) = '' then 'chunk 1: label is empty' end, case when id % 7 = 0 then 'chunk 1: content is empty' end,
    case when id % 11 = 0 then 'chunk 1: start_anchor: invalid_anchor' when regexp_replace(text, '[^\\pL\\pN]', '', 'g') = '' then 'chunk 1: start_anchor: low_confidence' end, case when id % 2 = 0 then 'link to ' || (id - 1) || ': not visible' end], lambda x: x is not null), '; ') problem from chunks""", lambda d: _validated(d))  # fmt: skip
simple("l_markup", "fsent chunks", """select s.serial_id, s.fragment_id, string_agg(case when c.retention in ('verbatim', 'detailed') then '<chunk retention="' || c.retention || '">' || s.text || '</chunk>' else s.text end, ' ' order by s.sidx) as markup from fsent s left join chunks c on c.serial_id = s.serial_id and c.fragment_id = s.fragment_id and c.sentence_index = s.sentence_index group by all""",
       lambda d: _marked(d))


def _marked(d: Digest) -> DataFrame:
    """editor.markup of every fragment, high retention only."""
    rows = d.fsent.join(d.chunks.select("serial_id", "fragment_id", "sentence_index", "label", "retention", "importance", lit(1).alias("c")), ["serial_id", "fragment_id", "sentence_index"], "left")
    rows = rows.groupBy("serial_id", "fragment_id").agg(F.sort_array(F.collect_list(F.struct("sidx", "text", "c", "label", "retention", "importance"))).alias("s"))

    def marked(s) -> str:
        return editor.markup([x["text"] for x in s], {k: [{"label": f"{k} {x['label']}", "retention": x["retention"], "importance": x["importance"]}] for k, x in enumerate(s) if x["c"] is not None}, high=True)

    return rows.select("serial_id", "fragment_id", through(marked, "string")("s").alias("markup"))


on("snk_plain_text", "select n_regionkey, string_agg(n_name || chr(10) || chr(10) || n_nationkey, chr(10) || chr(10) order by n_nationkey) || chr(10) as text from nation group by n_regionkey union all select -1, ''")(
    lambda t: t("nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("s")).select("n_regionkey", through(lambda s: export.plain_text([{"title": f" {x['n_name']} ", "serialId": int(x["n_nationkey"]), "children": []} for x in s], str), "string")("s").alias("text"))
    .unionByName(t("nation").limit(1).select(lit(-1).cast("long").alias("n_regionkey"), through(lambda _: export.plain_text([], str), "string")("n_name").alias("text"))))
_SEVERITY = "case l_returnflag when 'R' then 'critical' when 'A' then 'major' else 'minor' end"
_COST = "case l_returnflag when 'R' then 9 when 'A' then 3 else 1 end"


def _reviews(t) -> DataFrame:
    """Each order's lines as reviews with one issue."""
    return t("lineitem").groupBy(col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.expr(_SEVERITY).alias("severity"), F.concat(lit("part "), "l_partkey").alias("said")))).alias("s"))


def _issues(s) -> list[dict]:
    return [{"weight": float(x["l_linenumber"]), "issues": [{"severity": x["severity"], "problem": x["said"], "suggestion": "" if x["l_linenumber"] % 2 else "check"}]} for x in s]


on("a_review_score", f"select l_orderkey o_orderkey, (sum({_COST} * l_linenumber))::double score from lineitem group by l_orderkey")(
    lambda t: _reviews(t).select("o_orderkey", through(lambda s: float(editor.score_reviews(_issues(s))), "double")("s").alias("score")))
on("s_top_issues", f"""select l_orderkey o_orderkey, string_agg(case when r <= 3 then r || '. [' || upper(v) || ']' || chr(10) || '   Problem: part ' || l_partkey || chr(10) || case when l_linenumber % 2 = 0 then '   Suggestion: check' || chr(10) else '' end end, chr(10) order by r)
    || case when count(*) > 3 then chr(10) || '(' || (count(*) - 3) || ' lesser issues not shown)' else '' end as lines from (select *, {_SEVERITY} v, row_number() over (partition by l_orderkey order by {_COST} desc, l_linenumber desc, 'part ' || l_partkey) r from lineitem) group by l_orderkey""")(
    lambda t: _reviews(t).select("o_orderkey", through(lambda s: editor.issue_lines(_issues(s), 3), "string")("s").alias("lines")))
on("a_best_version", "select l_orderkey, min(l_linenumber)::bigint linenumber from lineitem l join (select l_orderkey, min(l_extendedprice) p from lineitem group by 1) using (l_orderkey) where l_extendedprice = p group by 1")(
    lambda t: t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("s")).select("l_orderkey", through(lambda s: int(editor.best_version([{"iteration": x["l_linenumber"], "score": x["l_extendedprice"]} for x in s])["iteration"]), "long")("s").alias("linenumber")))

# --- the store of snakes: runs of four chunks, so that its tables have SQL ---------------------------------------------------
_SNK = f"(select serial_id * {WIDE} + group_id * 1000 + sn id, serial_id, group_id, sn, count(*)::bigint size, sum(words)::bigint words, sum(weight) weight from {_snake_sql()} group by all)"
_MEM = f"(select serial_id * {WIDE} + group_id * 1000 + sn snake_id, id chunk_id, row_number() over (partition by serial_id, group_id, sn order by fragment_id, sentence_index, id) - 1 as position from {_snake_sql()})"
_SED = f"(select least(a.snake_id, b.snake_id) from_id, greatest(a.snake_id, b.snake_id) to_id, round(sum(e.weight), 6) weight from edges e join {_MEM} a on a.chunk_id = e.from_id join {_MEM} b on b.chunk_id = e.to_id where a.snake_id <> b.snake_id group by all)"
_sid = lambda: col("serial_id") * WIDE + col("group_id") * 1000 + col("sn")


def _snake_rows(d: Digest) -> DataFrame:
    return _runs(d).groupBy(_sid().alias("id"), "serial_id", "group_id").agg(F.count("*").alias("size"), F.sum("words").alias("words"), F.sum("weight").alias("weight"))


def _snake_members(d: Digest) -> DataFrame:
    return _runs(d).select(_sid().alias("snake_id"), col("id").alias("chunk_id"), (col("p") - 4 * col("sn")).alias("position"))


def _snake_edges(d: Digest) -> DataFrame:
    m = _snake_members(d)
    e = d.edges.select("from_id", "to_id", "weight").join(m.select(col("chunk_id").alias("from_id"), col("snake_id").alias("x")), "from_id").join(m.select(col("chunk_id").alias("to_id"), col("snake_id").alias("y")), "to_id").where("x <> y")
    return e.groupBy(F.least("x", "y").alias("from_id"), F.greatest("x", "y").alias("to_id")).agg(F.round(F.sum("weight"), 6).alias("weight"))


on("st_serials_create", "select c_custkey id, false as fresh from customer union all select (select max(c_custkey) from customer) + row_number() over (order by s_suppkey), true from supplier")(
    lambda t: store.allocate(t("customer").select(col("c_custkey").cast("long").alias("id"), lit(False).alias("fresh")), t("supplier").select("s_suppkey", lit(True).alias("fresh")), "s_suppkey"))
on("st_serials_create_with_id", "select c_custkey id from customer union all select (select max(c_custkey) from customer) + s_suppkey + 1 from supplier")(
    lambda t: store.create(t("customer").select(col("c_custkey").cast("long").alias("id")), t("supplier").crossJoin(F.broadcast(t("customer").agg(F.max("c_custkey").alias("m")))).select((col("m") + col("s_suppkey") + 1).cast("long").alias("id")), "id"))
simple("st_snakes_create", "chunks infos", f"select id, serial_id, group_id, size, case when id % 2 = 0 then words else 0 end words, case when id % 2 = 0 then weight else 0 end weight from {_SNK}",
       lambda d: store.append(_snake_rows(d).where("id % 2 = 0"), _snake_rows(d).where("id % 2 <> 0").select("id", "serial_id", "group_id", "size"), words=0, weight=0.0))
simple("st_snakes_get", "chunks infos", f"select id, size, words from {_SNK} where id in (0, {7 * WIDE + 1}, {11 * WIDE + 2})", lambda d: _snake_rows(d).where(col("id").isin(0, 7 * WIDE + 1, 11 * WIDE + 2)).select("id", "size", "words"))
simple("st_snakes_by_group", "chunks infos", f"select id from {_SNK} where serial_id = 7 and group_id = 0", lambda d: _snake_rows(d).where("serial_id = 7 and group_id = 0").select("id"))
simple("st_snakes_by_serial", "chunks infos", f"select group_id, id, size from {_SNK} where serial_id = 11", lambda d: _snake_rows(d).where("serial_id = 11").select("group_id", "id", "size").orderBy("group_id", "id"))
simple("st_snake_chunks_save", "chunks infos", f"select snake_id, chunk_id, position + case when chunk_id % 3 = 0 then 10 else 0 end as position from {_MEM}",
       lambda d: store.upsert(_snake_members(d), _snake_members(d).where("chunk_id % 3 = 0").select("snake_id", "chunk_id", (col("position") + 10).alias("position"), lit(1).alias("seq")), "snake_id", "chunk_id"))
simple("st_snake_chunks_list", "chunks infos", f"select snake_id, string_agg(chunk_id::varchar, ',' order by position) chunk_ids from {_MEM} group by snake_id",
       lambda d: _snake_members(d).groupBy("snake_id").agg(F.array_join(store.ordered(col("chunk_id").cast("string"), "position"), ",").alias("chunk_ids")))
simple("st_snake_edges_save", "edges chunks infos", f"select from_id, to_id, case when to_id % 2 = 0 then 1.5 else weight end weight from {_SED}",
       lambda d: (lambda e: store.upsert(e, e.where("to_id % 2 = 0").select("from_id", "to_id", lit(1.5).alias("weight"), lit(1).alias("seq")), "from_id", "to_id"))(_snake_edges(d)))
simple("st_snake_edges_in", "edges chunks infos", f"select from_id, to_id, weight from {_SED} where to_id in ({7 * WIDE + 1}, {11 * WIDE + 2})", lambda d: _snake_edges(d).where(col("to_id").isin(7 * WIDE + 1, 11 * WIDE + 2)))
simple("st_snake_edges_out", "edges chunks infos", f"select from_id, to_id, weight from {_SED} where from_id in ({7 * WIDE}, {11 * WIDE + 1})", lambda d: _snake_edges(d).where(col("from_id").isin(7 * WIDE, 11 * WIDE + 1)))
simple("st_snake_edges_within", "edges chunks infos", f"select from_id, to_id, weight from {_SED} where from_id % 3 <> 0 and to_id % 3 <> 0", lambda d: store.within(_snake_edges(d), _snake_rows(d).where("id % 3 <> 0"), "from_id", "to_id").select("from_id", "to_id", "weight"))
simple("st_snake_edges_by_serial", "edges chunks infos", f"select f.serial_id, e.from_id, e.to_id, e.weight from {_SED} e join {_SNK} f on f.id = e.from_id join {_SNK} t on t.id = e.to_id and t.serial_id = f.serial_id",
       lambda d: (lambda r: _snake_edges(d).join(r.select(col("id").alias("from_id"), "serial_id"), "from_id").join(r.select(col("id").alias("to_id"), col("serial_id").alias("s2")), "to_id").where("serial_id = s2").select("serial_id", "from_id", "to_id", "weight"))(_snake_rows(d)))

# --- streams and loops ------------------------------------------------------------------------------------------------
SQL["str_fragments"] = sql("select serial_id, fragment_id, sentence_index, text, words from fsent", "fsent")
QUERIES["str_fragments"] = lambda spark, sf_dir: pack_available(spark, f"{sf_dir}/documents.parquet*")
on("txt_language")(lambda t: t("documents").select("doc_id", "lang", language.language(col("text")).alias("detected")))


def _quotes(d: Digest) -> DataFrame:
    """Every sentence as start, and the sentence two further on, if there is one, as end."""
    f = d.fsent.select("serial_id", "sidx", "text")
    end = f.select("serial_id", (col("sidx") - 2).alias("sidx"), col("text").alias("end"))
    return f.join(end, ["serial_id", "sidx"], "left").select("serial_id", col("sidx").alias("quote_id"), col("text").alias("start"), "end")


entry("sim_resolve")(lambda d: evidence.resolve_all(d.fsent.select("serial_id", "sidx", "text"), _quotes(d)))
