"""The training-data operators on small tables of hard cases, against brute force."""

import hashlib
import json
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lamella.llm import chat, decontaminate, html_text, kernel, mixing, near_duplicates, packing, personal_data, quality, substrings, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, w string, mix_x long"
random.seed(5)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, step, seed):
    r = random.Random(seed)
    words = text.split()
    for i in range(step // 2, len(words), step):
        words[i] = r.choice(VOCAB)
    return " ".join(words)


BASE = prose(300, 1)
PASSAGE = prose(60, 2)
HARD = [
    (1, BASE), (2, BASE), (3, edited(BASE, 150, 3)), (4, prose(300, 4)), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, prose(40, 5) + " " + PASSAGE + " " + prose(30, 6)),
    (10, prose(50, 7) + "\n" + PASSAGE + "  " + prose(20, 8)), (11, PASSAGE), (12, "und " * 500), (13, "und " * 300), (14, prose(20_000, 9)), (15, "é" * 900), (16, "x" * 5000), (16, "x" * 5000), (17, "a b c d"), (18, "a b c d"),
    (None, BASE), (None, None), (19, PASSAGE + " " + PASSAGE), (20, prose(30, 10) + " " + " ".join(PASSAGE.split()[:49])), (21, "\x00 \x1f \x85 \xa0 💥 ñ"),
]
RAW = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[k % 3], ("a", "b", None, "c")[k % 4], None if t is None else len(t), "clash", 1) for k, (i, t) in enumerate(HARD)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_kernel_words():
    texts = [t or "" for _, t in HARD]
    for rows, raw, at in kernel.blocks(pa.record_batch({"text": pa.array([t for _, t in HARD])})):
        s, e, first = kernel.word_bounds(raw, at)
        assert rows.num_rows == len(first) - 1
        for k in range(rows.num_rows):
            got = [raw[a:b].tobytes().decode() for a, b in zip(s[first[k] : first[k + 1]], e[first[k] : first[k + 1]], strict=True)]
            assert got == RAW.findall((rows.column("text")[k].as_py() or ""))
    del texts


def test_kernel_minimizers_depend_on_the_window_alone():
    r = np.random.default_rng(1)
    key = r.integers(0, 2**63, 500, dtype=np.uint64)
    k, window = 3, 20
    pos = set(kernel.minimizers(key, np.array([0, 200, 210, 500]), k, window).tolist())
    want = set()
    for a, b in ((0, 200), (200, 210), (210, 500)):
        for s in range(a, b - window + 1):
            part = key[s : s + window - k + 1]
            want |= {s + int(i) for i in np.flatnonzero((part >> np.uint64(33)) == (part >> np.uint64(33)).min())}
    assert pos == want


def test_mixing(spark, docs, none):
    rows = mixing.plan(docs).collect()
    assert len(rows) == len(HARD)
    total = sum(r.mix_size for r in rows)
    per = {}
    for r in rows:
        per.setdefault(r.source, [0, r.mix_target, 0])
        per[r.source][0] += r.mix_size
        per[r.source][2] += r.mix_size * r.mix_copies
        assert 0 <= r.mix_copies <= 2 and r.mix_x == 1 and r.w == "clash"
    assert all(t <= 2 * s + 1e-6 for s, t, _ in per.values())
    assert sum(t for _, t, _ in per.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(r.mix_copies for r in rows)
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_targets_match_repeated_sharing(spark):
    r = random.Random(3)
    for _ in range(3):
        sizes = {f"s{i:02}": r.choice([1, 5, 50, 500]) for i in range(9)} | {None: 40}
        got = {x.mix_source: x.mix_target for x in mixing.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, mix_size long")).collect()}
        order = sorted((k for k in sizes if k), key=str) + [None]
        weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
        capped, want = set(), {}
        while True:
            left = 1.5 * sum(sizes.values()) - sum(2 * sizes[k] for k in capped)
            share = left / sum(weight[k] for k in order if k not in capped)
            over = {k for k in order if k not in capped and share * weight[k] > 2 * sizes[k]}
            if not over:
                break
            capped |= over
        want = {k: 2 * sizes[k] if k in capped else share * weight[k] for k in order}
        assert got == pytest.approx(want)


def brute_counts(text):
    words = RAW.findall(text or "")
    lines = [x for x in (text or "").split("\n") if RAW.search(x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, none):
    for text in [t for _, t in HARD] + ["a\na\n\n b\na #*", "a a a a", "x y z x y z q"]:
        assert quality.counts(text) == brute_counts(text)
    scored = quality.features(docs)
    done = quality.judge(scored, quality.thresholds(quality.sketches(scored)))
    assert done.count() == len(HARD) and set(docs.columns) <= set(done.columns)
    assert not done.where("q_base_failed and q_kept").count()
    assert quality.keep_good(docs).columns == docs.columns
    empty = quality.features(none)
    assert quality.judge(empty, quality.thresholds(quality.sketches(empty))).count() == 0


def test_quality_thresholds_adapt(spark):
    rows = [(i, " ".join([prose(60, i)] + ["#"] * (i % 3)), "en", "plain") for i in range(200)] + [(1000 + i, " ".join(f"{w}##" for w in prose(60, i).split()), "en", "marked") for i in range(200)] + [(5000, " ".join(f"{w}##" for w in prose(60, 9).split()), "en", "plain")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(d).collect()}
    assert len(kept & set(range(200))) >= 195 and len(kept & set(range(1000, 1200))) >= 195 and 5000 not in kept


def test_chat(spark):
    said = "</s>[INST] <|turn|> \\ <|end|>\n ok [/INST]"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", None), (2, 0, "system\nx\\", "s"), (3, 0, "assistant", ""), (3, 1, "assistant", "two 💥"), (3, 1, "assistant", "two 💥"), (None, 0, "user", "n"), (4, None, None, None), (4, 0, "assistant", "a" * 100_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    made = chat.examples(d)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        text = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert made.where("conv_id = 3").count() == 3
    for text in (said, "", "\\", "<\\|", "<<SYS>>[/INST]"):
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
    assert chat.examples(d.limit(0)).count() == 0


def test_near_duplicates(spark, docs, none):
    got = {(r.doc_id, r.n): r.class_id for r in near_duplicates.own_class(docs.withColumn("n", docs["n_chars"]), near_duplicates.classes(docs)).collect()}
    by = {k[0]: v for k, v in got.items() if k[0] is not None}
    assert by[1] == by[2] == by[3] == 1 and by[4] == 4 and by[17] == by[18] == 17
    assert by[5] == 5 and by[6] == 6 and by[7] == 7 and by[16] == 16
    assert len(near_duplicates.own_class(docs, near_duplicates.classes(docs)).collect()) == len(HARD)
    kept = near_duplicates.keep_one(docs)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and 2 not in ids and 3 not in ids and ids[16] == 1 and ids[None] == 2
    assert near_duplicates.classes(none).count() == 0


def labels(text):
    w, seen, out = RAW.findall(text), Counter(), []
    for k in range(max(1, len(w) - 4)):
        x = tuple(w[k : k + 5])
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def alignment(a, b):
    """Similarity by the longest common subsequence, with no band."""
    at = {x: k for k, x in enumerate(b)}
    places = [at[x] for x in a if x in at]
    best = [0] * (len(places) + 1)  # every labelled shingle stands once, so the longest increasing run of places is the longest common subsequence
    for k, x in enumerate(places):
        best[k] = 1 + max((best[j] for j in range(k) if places[j] < x), default=0)
    n = max(best)
    return n / (len(a) + len(b) - n)


def brute_classes(rows):
    seen = {i: labels(t) for i, t in rows}
    top = {i: i for i in seen}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = {i: set(x) for i, x in seen.items()}
    for i in seen:
        for j in seen:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and alignment(seen[i], seen[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {i: find(i) for i in seen}


@pytest.mark.parametrize(("small", "block"), [(30, 500), (3, 8)])
def test_near_duplicates_find_every_link(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_duplicates, "SMALL", small)
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rows = []
    for g in range(25):
        base = prose(random.Random(g).choice([6, 12, 30, 80, 300]), 100 + g)
        rows += [(g * 100 + k, base if k == 0 else edited(base, 70 + 13 * k, 1000 + g * 10 + k)) for k in range(6)]
    rows += [(9000 + k, prose(30, 7000 + k) + " " + PASSAGE) for k in range(40)]
    rows += [(20_000 + k, edited(prose(150, 77), max(1, 150 // (1 + k % 9)), 8000 + k)) for k in range(60)]
    rows += [(30_000 + k, "und " * (300 + k)) for k in range(5)]  # repeated text, told apart by its labels
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates.classes(d).collect()} == brute_classes(rows)


def test_near_duplicates_heed_the_order(spark):
    rows, moved = [], []
    for g in range(40):
        w = prose(600, 50_000 + g).split()
        rows += [(g * 100, " ".join(w)), (g * 100 + 1, edited(" ".join(w), 100, g)), (g * 100 + 2, " ".join(w[:295] + w[310:])), (g * 100 + 3, " ".join(w[300:] + w[:300]))]
        rows.append((g * 100 + 4, " ".join(x for k in (3, 1, 0, 2) for x in w[150 * k : 150 * k + 150])))
        moved += [g * 100 + 3, g * 100 + 4]
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[g * 100 + k] == g * 100 for g in range(40) for k in (0, 1, 2))
    assert all(got[i] == i for i in moved)


def test_near_duplicates_recall_on_the_given_table(spark):
    """All pairs of sf0.01 that are similar enough are in one class; 0.9 would be asked."""
    sf = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(sf).where("doc_id % 1 = 0")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if RAW.search(r.text or "")]
    held, pairs = defaultdict(set), set()
    seen = {i: labels(t) for i, t in rows}
    for i, x in seen.items():
        for y in set(x):
            held[y].add(i)
    count = Counter()
    for group in held.values():
        count.update((a, b) for a in group for b in group if a < b)
    for (a, b), n in count.items():
        if n >= 0.8 * (len(seen[a]) + len(seen[b]) - n) and alignment(seen[a], seen[b]) >= 0.8:
            pairs.add((a, b))
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()}
    assert len(pairs) > 50 and sum(got[a] == got[b] for a, b in pairs) == len(pairs)


def test_substrings(spark, docs, none):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", json.dumps(sorted({x for s in (r.sub_spans or []) for x in range(s.start, s.stop)}))) for r in substrings.with_spans(docs).collect())
    first = {}
    for i, t in HARD:
        w = RAW.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = []
    for i, t in HARD:
        w = RAW.findall(t or "")
        want.append((-1 if i is None else i, t or "", json.dumps(sorted({x for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}))))
    assert got == sorted(want)
    assert substrings.remove(docs).columns == docs.columns and substrings.remove(none).count() == 0


def brute_bytes(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    return [sorted({x for i in range(len(b) - 399) if seen[b[i : i + 400]] > 1 for x in range(i, i + 400)}) for b in data]


def test_suffixes(spark, docs, none):
    short = [(i, t if t is None or len(t) < 30_000 else t[:3000]) for i, t in HARD]
    d = spark.createDataFrame(short, "doc_id long, text string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", json.dumps(sorted({x for s in (r.suf_spans or []) for x in range(s.start, s.stop)}))) for r in suffixes.with_spans(d).collect())
    want = sorted((-1 if i is None else i, t or "", json.dumps(x)) for (i, t), x in zip(short, brute_bytes([t for _, t in short]), strict=True))
    assert got == want
    assert suffixes.remove(none).count() == 0 and suffixes.remove(docs).columns == docs.columns


def test_suffixes_report_passages_of_many_short_words(spark, tmp_path):
    short = " ".join(f"a{i % 10}{chr(98 + i // 10)}" for i in range(55))
    rows = [(1, prose(70, 1) + " " + short), (2, short + "\n" + prose(60, 2)), (3, prose(90, 3)), (4, "x " * 70), (5, "x  " * 60), (6, "y " * 60), (7, BASE), (8, BASE), (None, short), (9, None), (10, " ".join(short.split()[:49])), (11, short), (11, short)]
    assert len(short) < 400
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id or 0, r.n_spans, r.n_passages) for r in suffixes.query(spark, str(tmp_path)).collect())
    whole = {k: {tuple(w[i : i + 50]) for w in [RAW.findall(t or "")] for i in range(len(w) - 49)} for k, (_, t) in enumerate(rows)}
    same = lambda k, j: rows[k] == rows[j]  # noqa: E731  repeated rows are one document here
    want = [(i or 0, n, n or len({x for x in whole[k] if any(x in whole[j] for j in whole if not same(k, j))})) for k, (i, t) in enumerate(rows) for n in [len([1 for b in [brute_bytes([t for _, t in rows])[k]] for y, x in enumerate(b) if y == 0 or b[y - 1] != x - 1])]]
    assert got == sorted(want) and sum(n > 0 and not spans for _, spans, n in got) >= 5


def test_suffixes_with_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)
    core = prose(80, 50)
    texts = [prose(40 + k, 60 + k) + core[k : 330 + 9 * k] + prose(30, 90 + k) for k in range(14)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted({x for s in (r.suf_spans or []) for x in range(s.start, s.stop)}) for r in suffixes.with_spans(d).collect()}
    assert got == dict(enumerate(brute_bytes(texts)))


def test_suffix_sort_orders_and_survives_collisions(monkeypatch):
    r = random.Random(4)
    words = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 40))) for _ in range(200)]
    data = b"".join(words)
    at = np.cumsum([0, *map(len, words)])
    first = np.array([0, 1, 3, 3, 90, 200])
    for broken in (False, True):
        s = suffixes.Suffixes(data, at[:-1].copy(), at[1:].copy(), np.zeros(200, np.int64))
        if broken:
            s.sums = np.zeros_like(s.sums)  # every hash collides
        order, shared = s.sort(first)
        for a, b in zip(first[:-1], first[1:], strict=True):
            got = [words[i] for i in order[a:b]]
            assert got == sorted(words[a:b])
            for k in range(a + 1, b):
                x, y = words[order[k - 1]], words[order[k]]
                n = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
                assert shared[k] == n


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(PASSAGE.split()[5:25]).upper()), (2, "one"), (3, None), (4, " -- "), (5, "A b, C"), (6, "É" * 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    marks = {(k, tuple(w[i : i + min(10, len(w))])) for k, t in items for w in [cut(t)] if w for i in range(len(w) - min(10, len(w)) + 1)}
    want = []
    for i, t in HARD:
        w, hit, found = cut(t), set(), set()
        for k, m in marks:
            for a in range(len(w) - len(m) + 1):
                if tuple(w[a : a + len(m)]) == m:
                    hit |= set(range(a + 1, a + len(m) + 1))
                    found.add(str(k))
        want.append((-1 if i is None else i, t or "", sorted(hit), sorted(found)))
    for bound in (10_000, 0):
        got = [(-1 if r.doc_id is None else r.doc_id, r.text or "", r.bm_words, r.bm_items) for r in decontaminate.mark(docs, bench, bound=bound).collect()]
        assert sorted(got) == sorted(want)
    clean = decontaminate.drop_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[2] for x in want)
    assert decontaminate.drop_spans(docs, bench).count() == len(HARD)
    assert decontaminate.drop_documents(none, bench).count() == 0 and decontaminate.drop_documents(docs, bench.limit(0)).count() == len(HARD)


def test_html(spark):
    page = lambda body: f"<html><head><title>T</title><script>x</script></head><body>{body}</body></html>"
    assert html_text.main_text(page("<nav>m</nav><div class='ad'>no</div><article><h1>A &amp; B</h1><p>One <b>two</b>three<br>four<p>five</article><footer>f</footer>")) == "A & B One twothree four five"
    assert html_text.main_text(None) == "" and html_text.main_text("") == "" and html_text.main_text("<p>a") == "a"
    assert html_text.main_text("<" * 50 + "&#x41;&nbsp;&bogus; x") is not None
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"
    assert html_text.main_text(page("<article><p>x</p><section class='comments'><p>reader</p></section><form><p>f</p></form></article>")) == "x"
    box = "<div><p>Follow our site daily</p></div>"
    rows = [(i, "https://a.example/x", page(f"{box}<div><p>{prose(40, 300 + i)}</p></div>")) for i in range(12)] + [(50, None, page("<main>m</main>")), (51, "https://b.example/", page(box)), (52, "u", None), (50, None, page("<main>m</main>"))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == prose(40, 300 + i) for i in range(12)) and got[50] == "m" and got[51] == "Follow our site daily" and got[52] == ""
    assert html_text.extract(spark.createDataFrame(rows[:1], "page_id long, url string, html string").limit(0)).count() == 0


def test_html_templates_of_any_length_and_in_articles(spark):
    long = f"<div><p>{prose(300, 900)}</p></div>"
    box = "<div class='x1'><p>Read our daily letter</p></div>"
    outer = "<div><p>Outer words here</p></div>"
    copied, shared = prose(30, 901), f"<p>{prose(20, 902)}</p>"
    rows = [(i, "https://a.example/x", f"<body>{long}<div><p>{prose(20, 400 + i)}</p></div></body>") for i in range(12)]
    rows += [(100 + i, "https://b.example/x", f"<body>{outer}<main>{box}<p>{prose(20, 500 + i)}</p>{shared if i < 9 else ''}</main></body>") for i in range(100)]
    rows += [(300 + i, "https://b.example/y", f"<body><p>{i}</p><article><p>{copied}</p></article></body>") for i in range(12)]
    rows += [(400 + i, "https://c.example/y", f"<body><div><p>{copied}</p></div></body>") for i in range(12)]
    rows.append((500, "https://b.example/z", f"<body>{outer}<p>own</p></body>"))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[500] == "own"
    assert all(got[i] == prose(20, 400 + i) for i in range(12))
    assert all(got[100 + i] == prose(20, 500 + i) + (f" {prose(20, 902)}" if i < 9 else "") for i in range(100))
    assert all(got[k + i] == copied for i in range(12) for k in (300, 400))


def test_html_inside_articles():
    page = "<article><p>a</p><div class='side-effects'><p>dose table</p></div><p class='share price'>b</p><label>l</label><aside>quote</aside>{}<p>c</p></article>"
    assert html_text.main_text(page.format("")) == "a dose table b l quote c"
    for box in ("<div class='ad'>x</div>", "<section id=comments>x</section>", "<nav>x</nav>", "<footer>x</footer>", "<form><label>x</label></form>", "<div role='complementary'>x</div>", "<p hidden>x</p>"):
        assert html_text.main_text(page.format(box)) == "a dose table b l quote c"
    assert html_text.main_text("<div class='site-header'>x</div><div class='side-effects'>y</div><div class='side'>z</div>") == "y"


def brute_pages(rows):
    """The same by sets in memory: contents that hold a subtree, per host."""
    held, total = defaultdict(set), defaultdict(set)
    host = lambda u: (re.match(html_text._HOST, u or "") or [None, ""])[1].lower()
    trees = []
    for i, url, html in rows:
        root = html_text.parse(html or "")
        found = html_text.articles(root)
        inside, outside, content, whole = html_text.subtree_hashes(root, found)
        trees.append((i, url, html, found, inside, outside))
        for h in outside.values():
            held[host(url), False, h].add(whole)
        for h in inside.values():
            held[host(url), True, h].add(content)
        if found:
            total[host(url)].add(content)
    out = []
    for i, url, html, found, inside, outside in trees:
        gone = {h for h in (inside if found else outside).values() if len(held[host(url), bool(found), h]) >= html_text.PAGES and (not found or len(held[host(url), True, h]) >= html_text.SHARE * len(total[host(url)]))}
        out.append((i, html_text.main_text(html, gone)))
    return sorted(out)


@pytest.mark.parametrize("again", [100_000, 0])
def test_html_templates_against_brute_force(spark, monkeypatch, again):
    monkeypatch.setattr(html_text, "AGAIN", again)
    r = random.Random(8)
    boxes = [f"<div class='b{k}'><p>{prose(6, 3000 + k)}</p></div>" for k in range(6)]
    rows = []
    for i in range(300):
        parts = [f"<p>{prose(12, 4000 + i)}</p>", *(b for b in boxes if r.random() < 0.3)]
        r.shuffle(parts)
        body = "".join(parts)
        rows.append((i, f"https://h{r.randrange(5)}.example/{i}", r.choice([f"<article>{body}</article>", f"<main>{body}</main>{boxes[0]}", f"{boxes[1]}<div>{body}</div>"])))
    rows += [(900, None, None), (901, "", ""), rows[0], (0, rows[0][1], rows[1][2])]
    got = sorted((x.page_id, x.text) for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == brute_pages(rows)
    assert sum(text != html_text.main_text(html) for (_, text), (_, html) in zip(got, sorted((i, h) for i, _, h in rows), strict=True) if html and "<article" in html) > 20


def test_personal_data_base():
    t = "mail a.b@c.de, 10.0.0.256 10.0.0.1 4111 1111 1111 1111 +1 (310) 555-4510 a@b.c@d.e a@b.c_x@e.f"
    found = [(k, t[s:e]) for s, k, e in personal_data.base(t)]
    assert ("email", "a.b@c.de") in found and ("ip", "10.0.0.1") in found and ("phone", "+1 (310) 555-4510") in found and ("email", "_x@e.f") in found
    assert not [x for x in found if "256" in x[1]]
    assert personal_data.base("1" * 50_000) == [] and personal_data.base("a" * 50_000) == []


def luhn_number(seed, ok):
    r = random.Random(seed)
    n = "4" + "".join(str(r.randint(0, 9)) for _ in range(14))
    return next(n + str(d) for d in range(10) if personal_data.luhn(n + str(d)) == ok)


def test_personal_data_learns_contexts(spark):
    rows = [(i, f"{prose(10, i)} card number: {luhn_number(i, True)} {prose(5, i + 99)}") for i in range(30)]
    rows += [(100, f"{prose(8, 1)} card number: {luhn_number(77, False)} end"), (101, f"{prose(8, 1)} order {luhn_number(78, False)} end"), (102, None), (103, ""), (103, "x")]
    got = {r.doc_id: r.entities for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(e.kind, e.base) for e in got[100]] == [("card", False)] and got[101] == [] and got[102] == []
    assert all([(e.kind, e.base) for e in got[i]] == [("card", True)] for i in range(30))
    assert personal_data.find(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_personal_data_base_against_plain_patterns():
    r = random.Random(11)
    digits = lambda x: re.sub(r"[^0-9]", "", x)
    for _ in range(5000):
        text = "".join(r.choice(["a", "b.c", "@", ".", "1", "23", "4242", " ", "-", "+", "(", ")", "x@y.z", "255", "256", "4111 1111 1111 1111", "é", "\n"]) for _ in range(r.randint(0, 30)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and personal_data.luhn(digits(m[0]))]
        want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
        assert personal_data.base(text) == [(s, personal_data.KINDS[k], e) for s, k, e in sorted(want)]


def brute_scores(texts):
    """The rounds by dictionaries."""
    edges = {(i, x[3], x[4], p) for i, t in texts for x in personal_data.instances(t or "") for p in x[5]}
    seeds = {x for _, seed, x, _ in edges if seed}
    score, found = dict.fromkeys(seeds, 1.0), {}
    of, docs = defaultdict(set), defaultdict(set)
    for i, _, x, p in edges:
        of[p].add(x)
        docs[p].add((i, x))
    for _ in range(personal_data.ROUNDS):
        induced = {}
        for p, xs in of.items():
            known = [x for x in xs if score.get(x, 0) >= personal_data.FOUND]
            confidence = sum(score.get(x, 0) for x in xs) / len(xs)
            if len(known) >= personal_data.SUPPORT and confidence >= personal_data.CONFIDENCE and len({i for i, x in docs[p] if x in known}) >= personal_data.SUPPORT:
                induced[p] = confidence
        doubt = {}
        for x, p in {(x, p) for _, seed, x, p in edges if not seed and p in induced}:
            doubt[x] = doubt.get(x, 1.0) * (1 - min(induced[p], 0.99))
        found = {x: 1 - y for x, y in doubt.items()}
        score = found | dict.fromkeys(seeds, 1.0)
    return found


def test_personal_data_bootstraps(spark):
    r = random.Random(12)
    prose_ = lambda n, k: prose(n, k).translate(str.maketrans("0123456789", "abcdefghij"))  # noqa: E731  digits of words would count as equal
    common = ["the", "of", "and", "to"]
    say = lambda x, k: f"{prose_(r.randint(3, 20), k)} {r.choice(common)} {x} {r.choice(common)} {prose_(8, k + 1)}"
    rows = [(i, say(r.choice([f"u{i}.x@mail.example", f"10.0.{i}.7", luhn_number(i, True)]), i)) for i in range(100)]
    rows += [(200 + i, say(f"key=Q{r.randrange(10**9):09}z", 300 + i)) for i in range(40)]  # never a seed: found through its neighbours, then by its own word and form
    rows += [(300 + i, f"{prose_(9, i)} key=Q{r.randrange(10**9):09}z {prose_(9, i)}") for i in range(20)]
    rows += [(400 + i, f"part 2024-{i % 12:02}-{i:02} {prose_(9, i)}") for i in range(60)] + [(500, None), (501, rows[0][1]), (0, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    flat = personal_data.scan(d).selectExpr("doc_id", "tk", "explode(found) as x").select("doc_id", "tk", "x.*")
    got = {bytes(x.instance): x.score for x in personal_data.bootstrap(flat).collect()}
    assert got == pytest.approx(brute_scores(rows))
    every = [(x.doc_id, x.entities) for x in personal_data.find(d).collect()]
    assert len(every) == len(rows) and sum(i == 0 for i, _ in every) == 2
    by = dict(every)
    assert all([e.kind for e in by[i]] == ["other"] for k in (200, 300) for i in range(k, k + 20))
    assert all(by[400 + i] == [] for i in range(60)) and by[500] == []


CLASHES = [
    (lambda d, b: mixing.mix(d), ["mix_source", "mix_copy", "mix_size", "mix_target", "range", "row", "w", "place"]),
    (lambda d, b: quality.keep_good(d), ["q_lang", "q_source", "q_kept", "q_counts", "q_hi_symbols", "row"]),
    (lambda d, b: substrings.remove(d), ["s_id", "s_key", "sub_key", "sub_spans", "tk", "row"]),
    (lambda d, b: suffixes.remove(d), ["s_id", "s_key", "suf_key", "suf_spans", "tk", "row"]),
    (lambda d, b: near_duplicates.keep_one(d), ["nd_id", "nd_d", "nd_digest", "digest", "class_id", "rep", "row"]),
    (lambda d, b: decontaminate.drop_documents(d, b), ["hit_id", "hit_key", "doc_key", "bm_key", "h", "row"]),
    (lambda d, b: decontaminate.drop_spans(d, b), ["bm_words", "bm_items", "hit_id", "doc_key", "row"]),
]


@pytest.mark.parametrize(("remove", "names"), CLASHES)
def test_columns_with_clashing_names_are_kept(spark, remove, names):
    rows = [(i, t, "en", "a", *(f"{name} {i}" for name in names)) for i, t in enumerate([BASE, BASE, edited(BASE, 150, 3), PASSAGE + " " + prose(40, 1), prose(40, 2) + " " + PASSAGE, prose(90, 3), None])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{x} string" for x in names))
    bench = spark.createDataFrame([(1, PASSAGE, "x")], f"item_id long, text string, {names[0]} string")
    out = remove(d, bench)
    assert out.columns == d.columns
    got = out.collect()
    assert got and all(r[name] == f"{name} {r.doc_id}" for r in got for name in names)


@pytest.mark.parametrize("name", ["mix_size", "q_kept", "sub_spans", "suf_spans", "bm_words"])
def test_added_columns_replace_those_of_their_name(spark, name):
    d = spark.createDataFrame([(1, BASE, "en", "a", "mine")], f"doc_id long, text string, lang string, source string, {name} string")
    add = {"mix_size": mixing.plan, "q_kept": lambda x: quality.judge(s := quality.features(x), quality.thresholds(quality.sketches(s))), "sub_spans": substrings.with_spans, "suf_spans": suffixes.with_spans, "bm_words": lambda x: decontaminate.mark(x, x.select(x.doc_id.alias("item_id"), "text"))}[name]
    out = add(d)
    assert out.columns.count(name) == 1 and out.first()[name] != "mine"


def test_packing_rows():
    for seed in range(20):
        r = random.Random(seed)
        sizes = [r.randint(1, 64) for _ in range(r.randint(0, 200))]
        rows = packing.best_fit_decreasing(sizes, 64)
        assert sorted(k for row in rows for k in row) == list(range(len(sizes)))
        assert all(sum(sizes[k] for k in row) <= 64 for row in rows)
        room, used = [], []
        for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):  # the same by plain search
            fit = min((x for x in room if x >= sizes[k]), default=None)
            if fit is None:
                room.append(64)
                fit = 64
            room.remove(fit)
            room.append(fit - sizes[k])
            used.append(k)
        assert len(rows) == len(room)


def test_packing_is_lossless(spark, docs, none):
    odd = ["a\n\nb", "a  b", " x", "x ", "a\xa0b  \xa0c", "\t\tx  \n", "it's  we'll", "a\r\n b"]
    d = docs.select("doc_id", "text").where("doc_id is not null").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")).dropDuplicates(["doc_id"])
    parts = defaultdict(dict)
    for r in packing.pack(d, length=128, chunk=5000).collect():
        assert len(r.ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.resets == r.cu_seqlens[:-1]
        for k, (i, at) in enumerate(zip(r.doc_ids, r.offsets, strict=True)):
            parts[i][at] = r.ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]
    import public_tokenizers

    bpe = packing.encoder(public_tokenizers.path(packing.VOCABULARY)).bpe
    for i, t in ((r.doc_id, r.text) for r in d.collect()):
        ids = [x for at in sorted(parts[i]) for x in parts[i][at]]
        assert ids == bpe.encode_ordinary(t or "") + [packing.SEPARATOR]
    assert packing.pack(none).count() == 0


def test_packed_files_give_the_documents_back(spark, docs, none, tmp_path):
    import public_tokenizers

    d = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(3)
    manifest = packing.write(packing.pack(d, length=128, chunk=5000), (tmp_path / "out").as_uri())
    for part in manifest["parts"]:
        assert os.path.getsize(tmp_path / "out" / f"{part['part']}.ids") == 4 * 128 * part["rows"]
    assert not [x for x in os.listdir(tmp_path / "out") if x.startswith(".half")]
    parts = defaultdict(dict)
    for doc_id, offset, ids in packing.restore(str(tmp_path / "out")):
        parts[doc_id][offset] = ids.tolist()
    bpe = packing.encoder(public_tokenizers.path(packing.VOCABULARY)).bpe
    want = {r.doc_id: bpe.encode_ordinary(r.text or "") + [packing.SEPARATOR] for r in d.collect()}
    assert {i: [x for at in sorted(p) for x in p[at]] for i, p in parts.items()} == want
    first = tmp_path / "out" / f"{manifest['parts'][0]['part']}.ids"
    first.write_bytes(b"\1" + first.read_bytes()[1:])
    with pytest.raises(ValueError):
        list(packing.restore(str(tmp_path / "out")))
    assert packing.write(packing.pack(none), str(tmp_path / "none"))["parts"] == [] and list(packing.restore(str(tmp_path / "none"))) == []
