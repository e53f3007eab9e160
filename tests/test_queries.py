"""Every query with SQL against DuckDB on the smallest tables, and the streaming packer against the batch one."""

import hashlib
import json
import os

import duckdb
import pytest

import __spark_entry__ as contract
from lamella import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _normal(rows):
    return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(catalog.SQL[name]).to_arrow_table()
    assert sorted(want.column_names) == columns
    got = df.select(*columns).collect()
    kinds = dict(df.dtypes)
    expected = [tuple(float(r[c]) if r[c] is not None and kinds[c] == "double" else int(r[c]) if r[c] is not None and kinds[c] in ("bigint", "int") else r[c] for c in columns) for r in want.to_pylist()]
    assert _normal(map(tuple, got)) == _normal(expected)


def test_message_key_takes_every_turn(spark, tmp_path):
    said = ["plain", 'a\n\t"/\\ é', "", None]
    spark.createDataFrame([(1, k, "user", x) for k, x in enumerate(said)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.cache_key for r in catalog.QUERIES["l_message_key"](spark, str(tmp_path)).collect()}
    whole = [{"content": x, "role": "user"} if x is not None else {"role": "user"} for x in said]
    assert got == {k: hashlib.sha512(json.dumps(x, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for k, x in enumerate(whole)}


def test_html_text_of_odd_pages_equals_its_sql(spark, tmp_path):
    """References that nothing ends, such as a title cut within one; the operator itself reads them as HTML does."""
    from lamella.sources import epub

    said = ["<h1>cut &amp;&amp</h1><p>b</p>", '<h1>a = &quot</h1><p><b>a = &quot;</b> &copyx &amp x &ampx; a & b &; &am</p>', "<p>a &amp", "<p>a &amp</p>\n", "<p title='&amp'>x</p>&amp", "<p>\ue000 &middot</p>", "<iframe>?a=1&copy=2</iframe>", "", None]
    spark.createDataFrame(list(enumerate(said)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = dict(con.execute(catalog.SQL["src_html_text"]).fetchall())
    assert {r.page_id: r.text for r in catalog.QUERIES["src_html_text"](spark, str(tmp_path)).collect()} == want
    assert want[0] == "cut &&amp b" and want[2] == "a &" and want[8] is None
    assert epub.page_sections(said[0], [("p", None)])["p"] == "cut &&\n\nb"


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_invariants(spark):
    snakes = catalog.QUERIES["g_snakes"](spark, SF).toPandas()
    assert snakes.chunk_id.is_unique
    assert (snakes.groupby(["serial_id", "group_id", "local_snake_id"]).position.max() + 1 == snakes.groupby(["serial_id", "group_id", "local_snake_id"]).size()).all()


def test_stream_equals_batch(spark, tmp_path):
    from lamella.streaming.packer import fold, pack_stream

    text = "One two three. " * 300
    pieces = [(1, k, text[a : a + 97], a + 97 >= len(text)) for k, a in enumerate(range(0, len(text), 97))]
    spark.createDataFrame(pieces, "serial_id long, seq long, text string, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("serial_id long, seq long, text string, last boolean").parquet(str(tmp_path / "in"))
    q = pack_stream(source).writeStream.format("memory").queryName("packed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    want, _ = fold(1, [text], ("", 0, 0, 0), True)
    got = sorted(tuple(r) for r in spark.sql("select * from packed").collect())
    assert got == sorted(want)


def test_cache_keys_call_the_function(spark):
    from lamella.operators import model

    rows = {(r.conv_id, r.turn): (r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): r.cache_key for r in catalog.QUERIES["l_cache_key"](spark, SF).collect()}
    assert got == {k: model.cache_key([{"role": role, "content": text}], "m1", "p1", 0.5) for k, (role, text) in rows.items()}


def test_fragment_groups_and_snakes_by_plain_loops(spark):
    """Every serial and every group by the functions of one, without Spark."""
    from lamella.operators import graph, grouping
    from lamella.plans.digest import Digest

    d = Digest(spark, SF)
    by = {}
    for r in d.scored.collect():
        by.setdefault(r.serial_id, []).append((r.fragment_id, r.words_count, r.start_incision, r.end_incision))
    for limit in (600, 3840):
        want = sorted((s, g, f) for s, infos in by.items() for g, ids in enumerate(grouping.split(sorted(infos), limit)) for f in ids)
        assert sorted(map(tuple, grouping.fragment_groups(d.scored, limit).collect())) == want
    group = {(s, f): g for s, g, f in want}
    chunks, links = {}, {}
    for c in d.chunks.collect():
        if (c.serial_id, c.fragment_id) in group:
            chunks.setdefault((c.serial_id, group[c.serial_id, c.fragment_id]), {})[c.id] = {"words": c.words, "retention": c.retention, "importance": c.importance, "at": (c.serial_id, c.fragment_id, c.sentence_index)}
    home = {i: k for k, cs in chunks.items() for i in cs}
    for e in catalog._cut_edges(d).collect():
        if home.get(e.from_id) == home.get(e.to_id) is not None:
            links.setdefault(home[e.from_id], []).append((e.from_id, e.to_id, e.strength))
    members = {}
    for r in catalog.QUERIES["g_snakes"](spark, SF).collect():
        members.setdefault((r.serial_id, r.group_id), {}).setdefault(r.local_snake_id, []).append((r.position, r.chunk_id))
    assert set(members) == set(chunks)
    for k in chunks:
        own = sorted(links.get(k, []))
        want = sorted(s for ids in graph.split_components(sorted(chunks[k]), [(a, b) for a, b, _ in own]) for s in graph.Component({i: chunks[k][i] for i in ids}, [x for x in own if x[0] in set(ids)]).snakes())
        assert sorted([i for _, i in sorted(s)] for s in members[k].values()) == want


def test_every_sentence_is_resolved_as_by_the_function(spark):
    from lamella.operators import evidence
    from lamella.plans.digest import Digest

    texts = {}
    for r in Digest(spark, SF).fsent.orderBy("serial_id", "sidx").collect():
        texts.setdefault(r.serial_id, []).append(r.text)
    got = {(r.serial_id, r.quote_id): r for r in catalog.QUERIES["sim_resolve"](spark, SF).collect()}
    assert len(got) == sum(map(len, texts.values()))
    for s, among in texts.items():
        for k in range(0, len(among)):
            r = got[s, k]
            try:
                want = evidence.resolve({"start_anchor": among[k]} | ({"end_anchor": among[k + 2]} if k + 2 < len(among) else {}), among)
                assert r.indexes == want["indexes"] and r.strategy == want["strategy"]
            except evidence.Open as e:
                assert r.problem == f"{e.field}:{e.code}"
    sure = [r for r in got.values() if r.strategy and r.strategy.startswith("exact_raw")]
    assert len(sure) > 0.8 * len(got) and all(r.indexes[0] == r.quote_id for r in sure)


def test_language_is_detected(spark):
    """Measured against the language that the table names, over texts of at least ten words."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from lamella.functions.language import language

    said = rows.where("size(split(text, ' ')) >= 10")
    got = said.select("lang", language(said["text"]).alias("d")).collect()
    print(sum(r.lang == r.d for r in got) / len(got))
    assert sum(r.lang == r.d for r in got) >= 0.95 * len(got)
