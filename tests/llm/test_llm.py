"""Training-data operators against brute force, libraries and exact round trips."""

import base64
import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import bpe, buckets, decontaminate, html_crf, line_dedup, media_copies, near_dedup, quality_fm, reply_trees, token_count, warc
from barloom.llm.common import components, pieces, shared_dir

VOCABULARY = P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with what operators add or use inside.
EXTRA = "doc_id long, text string, id string, key string, score double, n_tokens int, component string, n_removed int, contaminated string"


def odd_texts() -> list:
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, long), (None, "null id"), (7, "tie tie"), (7, "tie tie"), (8, "<|endoftext|>a é 漢字 😀\x1c\x85    x")]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def with_extra(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 9.0, 9, "z", 9, "w") for i, t in rows], EXTRA)


def random_texts(n: int) -> list[str]:
    rng = random.Random(3)
    pieces = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "1", "23", "!", "?", "é", "ß", "漢", "😀", "\x1c", "\x85", " ", "<|endoftext|>", "the", "of", "́", "_", "aaaa", "\r\n", "　"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_tokens_as_the_library_has_them(spark):
    library = Tokenizer.from_file(VOCABULARY)
    texts = random_texts(1500) + [t or "" for _, t in odd_texts()] + ["a" * 3000, "ab" * 500]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    df = frame(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in bpe.encode(df, VOCABULARY).collect()}
    counts = {r["doc_id"]: r for r in token_count.count_tokens(df, VOCABULARY).collect()}
    for i, ids in enumerate(want):
        assert got[i]["ids"] == ids and got[i]["decoded"] == library.decode(ids, skip_special_tokens=False) == texts[i]
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert counts[i]["n_tokens"] == got[i]["n_tokens"] == len(ids) and counts[i]["n_bytes"] == len(texts[i].encode())
        assert counts[i]["over_limit"] == (len(ids) > 512)


def large_batch() -> pa.RecordBatch:
    """One batch as Spark hands it to a worker: 5,000 rows, 15 MB, null and empty texts and one of 5 MB."""
    long = "long words of one text " * 220_000
    texts = [*(f"row {k} " + "and the same words again " * 80 for k in range(5_000)), None, "", long, None]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def test_pieces_hold_all_rows_in_order():
    for texts in ([], [None, "abc", "", "\u00e9" * 5, None], [None, None], ["a" * 10] * 7, ["b" * 50, "", "c" * 50]):
        got = list(pieces(pa.array(texts, pa.string()), 10))
        assert [k for first, n in got for k in range(first, first + n)] == list(range(len(texts)))
        assert all(n == 1 or sum(len((t or "").encode()) for t in texts[first : first + n]) <= 10 for first, n in got)
    assert list(pieces(pa.nulls(3), 10)) == [(0, 3)]
    assert list(pieces(pa.array(["a" * 10] * 7).slice(2, 3), 20)) == [(0, 2), (2, 1)]


def test_encoding_hands_on_bounded_batches(spark):
    """The JVM takes ids a piece at a time, not those of a whole batch of texts at once."""
    part = large_batch()
    docs = spark.createDataFrame([], "doc_id long, text string")
    run = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f))
        bpe.encode(docs, P.path("byte_bpe_50k.json"), with_text=False)
    got = list(run[0](iter([part, part.slice(0, 0)])))
    assert max(b.nbytes for b in got if b.num_rows > 1) <= 4 * 2_000_000
    whole = pa.Table.from_batches(got)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert whole["doc_id"].to_pylist() == part["doc_id"].to_pylist()
    texts = part["text"].to_pylist()
    for k in (0, 1, 999, 1000, 4999, 5000, 5001, 5003):
        assert whole["ids"][k].as_py() == library.encode(texts[k] or "", add_special_tokens=False).ids
    assert whole["n_tokens"][5002].as_py() == len(library.encode(texts[5002], add_special_tokens=False).ids)
    assert whole["decoded_sha256"].to_pylist() == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]


def test_decontamination_looks_at_bounded_pieces(spark, monkeypatch):
    """The words of a few texts at a time are in memory, not those of a whole batch."""
    looks, seen = [], []
    udf, search = F.arrow_udf, decontaminate.Index.search
    monkeypatch.setattr(decontaminate.F, "arrow_udf", lambda f, kind: (looks.append(f), udf(f, kind))[1])
    monkeypatch.setattr(decontaminate.Index, "search", lambda self, texts: (seen.append((len(texts), sum(len(w) + 1 for t in texts for w in t))), search(self, texts))[1])
    item = "one benchmark item whose words stand nowhere else in these rows"
    part = large_batch()
    texts = part["text"].to_pylist()
    for k in (0, 998, 999, 4999):
        texts[k] += item
    decontaminate.find_items(frame(spark, [(1, "x")]), frame(spark, [(7, item)], "item_id long, text string"))
    found = looks[0](pa.array(texts, pa.string())).to_pylist()
    assert [k for k, x in enumerate(found) if x] == [0, 998, 999, 4999] and len(found) == len(texts)
    assert sum(n for n, _ in seen) == len(texts) and max(size for n, size in seen if n > 1) <= 4_000_000


def test_whole_tokens_are_proved():
    library = Tokenizer.from_file(VOCABULARY)
    whole = sorted(token_count.whole_tokens(VOCABULARY))
    assert len(whole) > 45_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(whole, add_special_tokens=False))


def test_token_edges(spark):
    for op in (lambda d: token_count.count_tokens(d, VOCABULARY), lambda d: bpe.encode(d, VOCABULARY)):
        out = op(with_extra(spark, odd_texts())).collect()
        assert len(out) == 10 and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2)} == {0}
        assert op(frame(spark, [])).count() == 0


def brute_components(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        s = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
        sets[i] = s
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, {i: len(sets[i]) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies_equal_brute_force(spark, size):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 30)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 6))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy).upper() if n % 3 == 0 else " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "Solo"), (n + 3, "solo")]
    want, sizes = brute_components(rows, size)
    got = near_dedup.near_copies(frame(spark, rows), size=size).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def made_rows(spark) -> tuple[int, int]:
    """Rows that joins and generators of all queries so far have made: their sum, and how many queries."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, total = store.executionsList(), 0
    for k in range(runs.size()):
        e = runs.apply(k)
        values = store.executionMetrics(e.executionId())
        nodes = store.planGraph(e.executionId()).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            if "Join" in node.name():
                for j in range(node.metrics().size()):
                    m = node.metrics().apply(j)
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total, runs.size()


def test_templated_texts_do_not_meet_in_pairs(spark):
    """Pages of one template, alike in 7 of 10 words: all share buckets, none is a near copy."""
    rng = random.Random(2)
    template = [f"t{i}" for i in range(120)]
    made = []
    for n in (400, 800):
        rows = [(i, " ".join(template + [f"u{rng.randrange(10**9)}" for _ in range(45)])) for i in range(n)]
        before = made_rows(spark)[0]
        got = near_dedup.near_copies(frame(spark, rows), size=2).collect()
        made.append(made_rows(spark)[0] - before)
        assert all(r["kept"] for r in got) and len(got) == n
    assert made[1] <= 2.2 * made[0]


def test_large_buckets_meet_by_rare_shingles(spark, monkeypatch):
    """Every bucket that holds two components is taken as a large one."""
    monkeypatch.setattr(buckets, "MEET", 0)
    monkeypatch.setattr(buckets, "LIKELY", 1)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for base in (rng.choices(words, k=k) for k in (4, 9, 30, 31, 32, 80, 81)):
        for _ in range(25):
            copy = [rng.choice(words) if rng.random() < 0.06 else w for w in base]
            rows.append((len(rows), " ".join(copy + rng.choices(words, k=rng.randint(0, 3)))))
    want, _ = brute_components(rows, 2)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_copies(frame(spark, rows), size=2).collect()} == want


def test_rare_pairs_hold_every_true_pair(spark):
    rng = random.Random(4)
    sets = [(i, i, rng.sample(range(40), rng.randint(1, 24))) for i in range(120)]
    sets += [(200 + i, 200 + i, list({*sets[i][2], *rng.sample(range(40), 2)})) for i in range(100)]
    got = {(min(r), max(r)) for r in near_dedup.rare_pairs(spark.createDataFrame(sets, "id long, part long, heavy array<long>"), 800_000).select("a", "b").collect()}
    true = {(a, b) for a, _, x in sets for b, _, y in sets if a < b and 10 * len(set(x) & set(y)) >= 8 * len(set(x) | set(y))}
    assert true <= got and len(true) > 50


def test_rare_pairs_of_large_sets(spark):
    """Sizes whose product with a million is beyond an int: sets of 2,147 and 2,148 shingles, and far larger ones."""
    shared = {n: range(n * 10_000, n * 10_000 + n - n // 20) for n in (2_147, 2_148, 2_684, 2_685, 9_000)}
    sets = [(n * 10 + k, n * 10 + k, [*of, *range(-(n * 10 + k) * 10_000, -(n * 10 + k) * 10_000 + n - len(of))]) for n, of in shared.items() for k in (0, 1)]
    got = {(min(r), max(r)) for r in near_dedup.rare_pairs(spark.createDataFrame(sets, "id long, part long, heavy array<long>"), 800_000).select("a", "b").collect()}
    assert got == {(n * 10, n * 10 + 1) for n in shared}


@pytest.mark.parametrize("size", [2, 5])
def test_large_buckets_of_long_texts(spark, monkeypatch, size):
    """Texts of 3,000 words that share buckets in different components."""
    monkeypatch.setattr(buckets, "MEET", 0)
    base = [f"w{i}" for i in range(3_000)]
    rows = [(i, " ".join(base[: i * 400] + [f"own{i}x{j}" for j in range(400)] + base[i * 400 + 400 :])) for i in range(5)]
    rows.append((5, rows[2][1] + " and more"))
    want, sizes = brute_components(rows, size)
    got = near_dedup.near_copies(frame(spark, rows), size=size).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 2}
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes and min(sizes.values()) > 2_900


def test_near_copies_edges(spark):
    out = near_dedup.near_copies(with_extra(spark, odd_texts()), size=2).collect()
    assert len(out) == 10
    by = {r["doc_id"]: r for r in out}
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[1]["kept"] and by[None]["kept"] and by[None]["component_id"] is None
    assert near_dedup.near_copies(frame(spark, []), size=2).count() == 0
    one = near_dedup.keep_one(with_extra(spark, odd_texts()), size=2)
    assert one.count() == 8 and one.columns == with_extra(spark, []).columns


def test_near_copies_take_few_jobs(spark, tmp_path):
    """The driver keeps a record of all stages: each table is worked out once, and no table stays behind."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(40)]
    rows += [(100 + i, t.rsplit(" ", 1)[0] + " more") for i, t in rows[::2]]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "docs"))
    docs, jobs = spark.read.parquet(str(tmp_path / "docs")), spark._jsc.sc().dagScheduler().numTotalJobs
    before, held = jobs(), set(os.listdir(shared_dir(spark)))
    out = near_dedup.near_copies(docs, size=2)
    made = jobs() - before
    assert sum(not r["kept"] for r in out.collect()) == 20
    assert not [f for f in set(os.listdir(shared_dir(spark))) - held if f.startswith("near-")]
    assert made <= 70, made


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    m = near_dedup.MinHash(40, 5)
    limit = near_dedup.sketch_limit(0.8, 200, 1024)
    a = rng.integers(0, 2**64, 900, np.uint64)
    for same, passes in ((801, True), (300, False)):
        b = np.concatenate([a[:same], rng.integers(0, 2**64, 900 - same, np.uint64)])
        x, y = (m.odd_sketch(m.samples(np.unique(s))) for s in (a, b))
        assert (int(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum()) <= limit) == passes


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 1), (3, 3), (5, 2)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[5] == got[2] == 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_fm.train(docs, labels)
    r = quality_fm.classify(docs, model).join(labels, "doc_id").where(quality_fm.held_out()).toPandas()
    assert (r["predicted"] == r["quality"]).mean() > 0.95
    again = quality_fm.train(docs.repartition(7), labels)
    assert np.array_equal(again.linear, model.linear)


def test_quality_identity_and_edges(spark):
    rng = np.random.default_rng(1)
    m = quality_fm.FactorisationMachine(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 6)).astype(np.float32))
    at, value = np.array([1, 7, 30, 44]), np.array([0.5, 1, 2, 0.25], np.float32)
    pairs = sum(float(m.factors[at[i]] @ m.factors[at[j]]) * value[i] * value[j] for i in range(4) for j in range(i))
    assert m.raw(at, value, np.array([0]))[0] == pytest.approx(0.3 + float(m.linear[at] @ value) + pairs, rel=1e-4)
    empty = quality_fm.train(frame(spark, []), frame(spark, [], "doc_id long, quality int"), metadata=())
    out = quality_fm.classify(with_extra(spark, odd_texts()), empty, metadata=()).collect()
    assert len(out) == 10 and all(0 <= r["score"] <= 1 and r["id"] == "x" for r in out)
    assert quality_fm.classify(frame(spark, []), empty, metadata=()).count() == 0
    known = quality_fm.train(spark.createDataFrame([(i, t, None) for i, t in odd_texts()], "doc_id long, text string, n_chars long"), spark.createDataFrame([(1, 0), (2, None), (None, 1), (5, 1), (5, 0)], "doc_id long, quality int"))
    assert np.isfinite(known.linear).all()


def test_quality_fit_is_bounded_with_repeated_ids(spark):
    docs = frame(spark, [(1, f"text number {i % 3}") for i in range(3000)] + [(i, f"some words {i}") for i in range(2, 40)]).withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] * 2, "doc_id long, quality int")
    seen = []
    real = quality_fm.fit
    quality_fm.fit = lambda rows, *a, **k: seen.append(len(rows)) or real(rows, *a, **k)
    try:
        one, two = (quality_fm.train(docs.repartition(n), labels, fit_rows=2) for n in (3, 7))
    finally:
        quality_fm.fit = real
    assert seen == [4, 4] and np.array_equal(one.linear, two.linear)


def test_html_field_on_unseen_pages():
    field, wrong, total = html_crf.trained(), 0, 0
    for rows, labels in html_crf.labelled_blocks(4321, 150):
        got = field.decode(rows)
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.02


def test_html_viterbi_is_exact():
    field = html_crf.trained()
    rows = html_crf.labelled_blocks(5, 1)[0][0][:9]
    emitted = [float(field.weight[r].sum()) for r in rows]

    def value(states):
        total = field.first[states[0]] + emitted[0] * states[0]
        return total + sum(field.transition[a, b] + e * b for a, b, e in zip(states, states[1:], emitted[1:], strict=False))

    best = max(([k >> i & 1 for i in range(len(rows))] for k in range(2 ** len(rows))), key=value)
    assert field.decode(rows) == [bool(s) for s in best]


def test_html_edges(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>One<b>two</b>\n three&nbsp;x<p>Four<script>no</script><!-- no --><div class=ad>Buy</div></article><footer>&copy; f</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p <a <<>"), (None, "u", page), (5, "u", "<article>" + "<p>long text here.</p>" * 3000 + "</article>"), (1, "u", page)]
    out = html_crf.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("x"))).collect()
    by = {r["page_id"]: r for r in out}
    assert len(out) == 7 and by[1]["text"] == "A & B Onetwo three x Four" and by[2]["text"] == by[3]["text"] == ""
    assert by[5]["n_chars"] == len(by[5]["text"]) == 3000 * 16 - 1
    assert html_crf.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("before", ['<svg class="i"/>', "<svg-icon name=x></svg-icon>", "<video-player>", "<svg class=i />", "<video src=x />", "<object data=x>", "<audio>", "<canvas>", "<select>", "<iframe src=x>", "<script src='x'/>", "<style />", "<textarea/>", "<template-x>", "<script>a</script x>"])
def test_html_text_after_an_element_stays(before):
    assert "".join(b.text for b in html_crf.blocks_of(f"<article>{before}<p>body</p></article>")) == "body"


def test_html_skips_only_what_is_no_text():
    text = lambda page: " ".join(b.text for b in html_crf.blocks_of(page))
    assert text("<p>so <math><mi>x</mi></math> is<object>fallback</object></p>") == "so x isfallback"
    assert text("<p>a<script src=/js/>if (1 > 0) {}</script>b<style>p {}</style>c<textarea>t</textarea><template><p>u</template>d</p><script>rest") == "abcd"


def test_html_open_elements_have_no_limit():
    deep = "<b>" * 3000
    page = f"<article class=story>{deep}<p>one</p><nav class=menu><a>two</a></nav><div><i>three</i></div></article><footer>four</footer>"
    got = [(b.text, set(b.path) - {"b"}, set(b.names), b.linked) for b in html_crf.blocks_of(page)]
    assert got == [("one", {"article", "p"}, {"story"}, 0), ("two", {"article", "nav"}, {"story", "menu"}, 3), ("three", {"article", "div"}, {"story"}, 0), ("four", {"footer"}, set(), 0)]


#: Pages written by hand, none of them from the training generator: (page, its main text).
PAGES = [
    ("<article><p>Real text.</p></article>", "Real text."),
    ("<p>Alone on the page</p>", "Alone on the page"),
    ("Only words, no markup", "Only words, no markup"),
    ("<html><body><article><p>" + "One long paragraph without a title. " * 24 + "</p></article></body></html>", ("One long paragraph without a title. " * 24).strip()),
    ("<!DOCTYPE html><html lang=en><head><title>Bread - Kitchen notes</title><meta name=viewport content='width=device-width'></head><body class='home blog'><header class='site-header'><a href='/'>Kitchen notes</a></header><nav class='main-nav'><a href='/a'>Recipes</a> <a href='/b'>About</a></nav><main><article><h1>Bread</h1><p>Mix flour &amp; water.</p><p>Wait a day, then bake.</p></article></main><footer>&copy; 2021 Kitchen notes</footer></body></html>", "Bread Mix flour & water. Wait a day, then bake."),
    ("<html><body><div id='navigation'><ul><li><a href=x>Start</a><li><a href=y>News</a></ul></div><div class='post'><h2>A walk</h2><p>We went up the hill.<p>It rained.</div><div id='sidebar'><h3>Archive</h3><ul><li><a href=z>March</a></ul></div></body></html>", "A walk We went up the hill. It rained."),
    ("<body><div class='cookie-banner'>We use cookies. <button>Agree</button></div><article><h1>Rivers</h1><p>Rivers carry sand.</p></article></body>", "Rivers Rivers carry sand."),
    ("<main><h1>Title</h1><p>First.</p><aside class='ad-box'>Buy now!</aside><p>Second.</p></main>", "Title First. Second."),
    ("<article><h1>Talk</h1><p>The text itself.</p><section id='comments'><h2>3 comments</h2><div class='comment'><p>I disagree.</p></div><div class='comment'><p>Me too!</p></div></section></article>", "Talk The text itself."),
    ("<article><p>Before.</p><form action='/join' class='newsletter'><label>Your mail</label><input><button>Join</button></form><p>After.</p></article>", "Before. After."),
    ("<article><p>The mass is <math><mi>m</mi></math> kilograms.</p><noscript><p>Shown without scripts.</p></noscript><p>See <svg><text>figure</text></svg> one.</p></article>", "The mass is m kilograms. Shown without scripts. See figure one."),
    ("<article><script src=\"x>var a = 'hidden';</script><p>Shown.</p></article>", "Shown."),
    ("<article><script>if (a < b) { document.write('<p>no</p>') }</script><style>.x > p { color: red }</style><p>Yes.</p></article>", "Yes."),
    ("<article><p title='5 > 3'>Math is <b class=\"x\">fun</b>.</p></article>", "Math is fun."),
    ("<article><!-- <p>not this</p> --><p>This&nbsp;one,\n  with   space.</p></article>", "This one, with space."),
    ("<article><h1>Steps</h1><ol><li>Open the box.<li>Take it out.</ol><table><tr><th>Part<th>Count<tr><td>Bolt<td>4</table></article>", "Steps Open the box. Take it out. Part Count Bolt 4"),
    ("<article><blockquote><p>To be or not to be.</p></blockquote><pre>a = 1\nb = 2</pre></article>", "To be or not to be. a = 1 b = 2"),
    ("<nav><ul><li><a href=/>Home</a></ul></nav><footer><p>&copy; nobody</p></footer>", ""),
    ("<div role='main'><h1>Cats</h1><p>Cats sleep most of the day.</p></div><div class='footer'>Imprint</div>", "Cats Cats sleep most of the day."),
    ("<article><p>Cut off in a ta", "Cut off in a ta"),
    ("<article><p>Cut off in a tag.</p><p class=\"x", "Cut off in a tag."),
    ("<ARTICLE><H1>UPPER CASE</H1><P>Tags in capitals.</ARTICLE><FOOTER>end</FOOTER>", "UPPER CASE Tags in capitals."),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_html_pages_written_by_hand(page, text):
    assert html_crf.extract(page, html_crf.trained()) == text


def test_html_bears_hostile_markup_in_linear_time():
    import time

    field = html_crf.trained()
    many = 100_000
    pages = ["<p " + '"' * many, "<p a=" + '"' * (many + 1) + ">x", "<a b=\">" * (many // 2), "<a b='><p c=\">" * (many // 4), "<" * many, "</" * many, "<!--" * many, "<script>" * many, "<p><div>" + "<b>" * (many // 2) + "<p></p>" * (many // 2), "".join(f'<div class="content{k % 50}x{k}">' for k in range(many // 10)) + "<p>deep</p>", "</i>" * many, "<a " + "b = " * many, "<a " + "/ " * many + ">t"]
    began = time.time()
    texts = [html_crf.extract(p, field) for p in pages]
    assert time.time() - began < 30 and texts[9] == "deep"


def test_html_deep_nesting_keeps_the_ancestors():
    page = "<article>" + "<div>" * 10_000 + "<p>one</p>" + "<footer>two</footer>" + "</div>" * 10_000 + "<p>three</p></article><footer>four</footer>"
    assert [(b.text, "footer" in b.path, "article" in b.path) for b in html_crf.blocks_of(page)] == [("one", False, True), ("two", True, True), ("three", False, True), ("four", True, False)]


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y é", "same é"), (2, None, "same é"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (None, "u", "same é"), (6, "u", "\r\n\r\nWARC/1.0\r\n\r\n"), (6, "u", "\r\n\r\nWARC/1.0\r\n\r\n")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h in rows:
        first[digest(h)] = max(first.get(digest(h), -1), -1 if i is None else i)
    want = sorted(str((i, len((h or "").encode()), digest(h), "response" if i == first[digest(h)] else "revisit", None if i == first[digest(h)] else first[digest(h)])) for i, _, h in rows)
    assert sorted(str(tuple(r)) for r in warc.round_trip(df).collect()) == want
    small = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, smallest=1).collect()}
    assert small[3] == small[4] == "response"
    path = str(tmp_path / "w")
    warc.archive(df, path)
    read = warc.read_warc(spark, path)
    assert read.where("record_type = 'revisit'").count() == 3 and read.where("payload IS NULL").count() == 3
    assert {r["payload"].decode() for r in read.where("record_type = 'response' AND record_id = 'urn:row:5'").collect()} == {"x" * 300_000}
    plan = read.where("record_type = 'response'").select("record_id")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_plain_archive(spark, tmp_path):
    plain = b"".join(warc.record({"record_id": f"urn:row:{i}", "record_type": "response", "payload": b"p" * i, "payload_length": i}) for i in range(40))
    (tmp_path / "a.warc").write_bytes(plain)
    got = warc.read_warc(spark, str(tmp_path)).where("record_type = 'response'").collect()
    assert sorted(len(r["payload"]) for r in got) == list(range(40))


def gzip_records() -> list[bytes]:
    """Records of someone else's archive: names in small letters, a folded header, large blocks."""
    out = []
    for k in range(6):
        kind = "response" if k % 2 else "request"
        body = bytes([65 + k]) * (200_000 + k)
        out.append(f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-record-ID: <urn:x:{k}>\r\nx-note: one\r\n two\r\ncontent-length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    return out


def test_warc_reads_archives_from_elsewhere(spark, tmp_path):
    import gzip

    records = gzip_records()
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    read = warc.read_warc(spark, str(tmp_path))
    got = [(r["record_id"], len(r["payload"]), r["headers"]["x-note"]) for r in read.where("record_type = 'response'").collect()]
    assert sorted(got) == sorted(3 * [(f"urn:x:{k}", 200_000 + k, "one two") for k in (1, 3, 5)])
    assert read.count() == 18 and read.select("record_id").where("record_id = 'urn:x:4'").count() == 3


def test_warc_looks_at_headers_first(monkeypatch):
    import gzip
    import io

    records = gzip_records()
    wanted = lambda h: h["WARC-Type"] == "response"
    from pyspark.sql.datasource import EqualTo, IsNotNull
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    reader = warc.WarcReader(StructType([StructField("record_type", StringType()), StructField("payload", BinaryType())]), {"path": "/x"})
    assert list(reader.pushFilters([IsNotNull(("record_type",)), EqualTo(("record_type",), "response")])) == []
    data = b"".join(warc.member(r) for r in records)

    opened = []
    real = warc.zlib.decompress
    monkeypatch.setattr(warc.zlib, "decompress", lambda x, w: opened.append(len(x)) or real(x, w))
    assert [h["WARC-Record-ID"] for h, _ in warc.records_of(io.BytesIO(data), wanted, False)] == [f"<urn:x:{k}>" for k in (1, 3, 5)] and not opened
    assert [len(b) for _, b in warc.records_of(io.BytesIO(data), wanted, True)] == [200_001, 200_003, 200_005] and len(opened) == 3
    source = warc.Buffered(io.BytesIO(gzip.compress(b"".join(records))))
    member = warc.Member(source)
    first = warc.parse_head(warc.head_of(member))
    assert first["WARC-Type"] == "request" and member.inflated <= 2 * warc.PIECE
    for _ in warc.plain_records(member, wanted, False):
        assert len(member.held) <= 2 * warc.PIECE
    cut_off = gzip.compress(records[1])[:-100]
    assert len(list(warc.records_of(io.BytesIO(cut_off), wanted, True))) == 1


def test_warc_keys_of_any_kind(spark):
    keys = ["a" * 100, "%41 +&/ é\r\n\x00<>", "", None, "plain"]
    df = spark.createDataFrame([(k, "u", f"text {i}") for i, k in enumerate(keys)] + [("zz" * 40, "u", "text 0")], "page_id string, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    assert got == {("zz" * 40, "response", None), ("a" * 100, "revisit", "zz" * 40), *((k, "response", None) for k in keys[1:])}


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "a ### </turn> \\", 5.0), ("t", 3, 1, "assistant", None, 9.0), ("t", 4, 2, "us:er", "\\### x", 1.0), ("t", 5, 99, "user", "orphan", 0.0), ("c", 1, 2, "user", "loop", 0.0), ("c", 2, 1, "user", "loop", 0.0), ("c", 3, 1, "user", "below", 0.0), (None, 1, None, "user", "", None), ("t", 1, None, "user", "q", 1.0)]
    df = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, role string, text string, score double").withColumn("leaf", F.lit("clash"))
    out = reply_trees.format_trees(df, score="score")
    got = {(r["tree"], r["leaf"]): r for r in out.select("*", reply_trees.turns_of(F.col("formatted")).alias("turns"), reply_trees.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {("t", 3), ("t", 4), ("t", 5), (None, 1)}
    assert [(t["role"], t["text"]) for t in got[("t", 4)]["turns"]] == [("user", "q"), ("assistant", "a ### </turn> \\"), ("us:er", "\\### x")]
    assert got[("t", 4)]["loss"] == "a ### </turn> \\" and got[("t", 3)]["loss"] == ""
    assert [r["leaf"] for r in reply_trees.format_trees(df, score="score", top=1).where("tree = 't'").collect()] == [3]
    assert reply_trees.format_trees(df.limit(0)).count() == 0
    deep = spark.createDataFrame([("d", i, i - 1 if i else None, "user", str(i)) for i in range(300)], "tree_id string, node_id long, parent_id long, role string, text string")
    assert reply_trees.format_trees(deep).first()["n_turns"] == 300


def brute_lines(rows, least):
    docs = {i: (t.split("\n") if t is not None else []) for i, t in rows}
    plain = {i: [(k, " ".join(x.split())) for k, x in enumerate(ls) if x.split()] for i, ls in docs.items()}
    seen, gone = {}, {i: set() for i in docs}
    for i in sorted(docs):
        u = plain[i]
        for k in range(len(u)):
            n = e = 0
            while k + e < len(u) and n < least:
                n += len(u[k + e][1].split())
                e += 1
            if n < least:
                continue
            window = tuple(x for _, x in u[k : k + e])
            for j, m in seen.get(window, ()):
                f = e
                while k + f < len(u) and m + f < len(plain[j]) and u[k + f][1] == plain[j][m + f][1]:
                    f += 1
                gone[i] |= {p for p, _ in u[k : k + f]}
            seen.setdefault(window, []).append((i, k))
    return {i: ("\n".join(x for k, x in enumerate(ls) if k not in gone[i]), len(gone[i])) for i, ls in docs.items()}


def test_line_winnowing_equals_brute_force(spark):
    rng = random.Random(5)
    stock = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 3, 8, 20, 60]))) for _ in range(14)]
    rows = [(i, "\n".join(rng.choice([*stock, "", "  "]) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    want = brute_lines(rows, 50)
    got = line_dedup.remove_repeats(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got} == want and any(n for _, n in want.values())


def test_repeats_of_a_later_place_go(spark):
    p, x, y, z = "p " * 60, "x " * 10, "y " * 10, "z " * 49
    rows = [(1, f"{p}\n{x}"), (2, f"{p}\n{y}\n{z}"), (3, f"{p}\n{y}"), (4, f"{p}\n{y}\n{z}\nend"), (5, f"{y}\n{z}\n\n{x}"), (6, f"{z}\nq\n{z}\nq")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    want = brute_lines(rows, 50)
    assert got == {i: t for i, (t, _) in want.items()} and got[3] == "" and got[2] == f"{y}\n{z}" and got[4] == "end" and got[5] == f"\n{x}" and got[6] == f"{z}\nq"


def test_columns_named_like_helpers_stay(spark):
    names = ["id", "dk", "gone", "lines", "_text", "__text", "__lines", "N_chars"]
    docs = frame(spark, [(1, "a " * 60), (2, "a " * 60 + "\nb")]).select("*", *[F.lit(n).alias(n) for n in names])
    out = line_dedup.remove_repeats(docs).orderBy("doc_id").collect()
    assert out[1]["text"] == "b" and all(r[n] == n for r in out for n in names)


def test_line_edges(spark):
    out = line_dedup.remove_repeats(with_extra(spark, odd_texts())).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 10 and by[1]["text"] is None and by[1]["n_lines"] == 0 and by[6]["text"] == "" and by[5]["n_removed"] == 0 and by[5]["id"] == "x"
    assert line_dedup.remove_repeats(frame(spark, [])).count() == 0
    docs = spark.createDataFrame([(1, "a " * 60, "en", "s", 120), (2, "a " * 60 + "\nb", "en", "s", 122)], DOCS)
    assert [(r["text"], r["n_chars"]) for r in line_dedup.remove_repeats(docs).orderBy("doc_id").collect()][1] == ("b", 1)
    plan = line_dedup.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def sellers(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def edited_copies(n):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(8, 60)))) for k in range(40)]
    rows = []
    for i in range(n):
        host = rng.choices(words, k=rng.randint(0, 120))
        if i % 2:
            e = items[rng.randrange(40)][1].split()
            for _ in range(rng.randint(0, decontaminate.allowed(len(e)))):
                p = rng.randrange(len(e))
                e[p : p + 1] = rng.choice([[], [rng.choice(words)], [e[p], rng.choice(words)]])
            q = rng.randint(0, len(host))
            host[q:q] = e
        rows.append((i, ", ".join(host).title()))
    return items, rows


def test_decontamination_recall_against_brute_force(spark):
    items, rows = edited_copies(300)
    want = {i: {k for k, t in items if sellers(t.split(), decontaminate.words_of(x)) <= decontaminate.allowed(len(t.split()))} for i, x in rows}
    df = decontaminate.find_items(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: set(r["item_ids"]) for r in df.collect()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(len(got[i]) for i in want) >= 0.98 * sum(map(len, want.values())) > 100
    blocks = decontaminate.find_items(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=2000)
    assert {r["doc_id"]: set(r["item_ids"]) for r in blocks.collect()} == got


@pytest.mark.parametrize("n", [7, 40, 58, 150, 400, 1500])
def test_decontamination_finds_every_placement_of_edits(n):
    k = decontaminate.allowed(n)
    item = [f"w{i}" for i in range(n)]
    new = [f"w{n + i}" for i in range(k)]
    every = lambda at: [new[at.index(i)] if i in at else w for i, w in enumerate(item)]
    copies = [every(range(k)), item[k:], new + item, every(range(0, 2 * k, 2)), every(range(n - k, n)), item[: n - k], every(range(n // 2 - k // 2, n // 2 - k // 2 + k)), every(range(4, 5 * k, 5)), item]
    beyond = [item[k + 1 :], ["w0"] * n, []]
    index = decontaminate.Index([(1, item), (2, [f"w{n - i}" for i in range(n)])])
    got = index.search([["x"] * 9 + c + ["y"] * 9 for c in copies] + beyond)
    assert [0 in g for g in got] == [True] * len(copies) + [False] * len(beyond)
    assert all(g[0] == sellers(item, c) for g, c in zip(got, copies)) if n < 200 else True
    other = decontaminate.Index([(2, [f"v{i}" for i in range(3 * n)]), (1, item)])
    assert all(1 in g for g in other.search(copies))


def test_decontamination_equals_brute_force_on_few_words():
    rng = random.Random(12)
    items = [(k, rng.choices("abcdefghij", k=rng.randint(1, 25))) for k in range(30)]
    texts = [rng.choices("abcdefghijkl", k=rng.randint(0, 80)) for _ in range(120)]
    got = decontaminate.Index(items).search(texts)
    want = [{k: d for k, t in items if (d := sellers(t, x)) <= decontaminate.allowed(len(t))} for x in texts]
    assert got == want


@pytest.mark.parametrize("how", ["front", "back", "spread"])
def test_decontamination_recall_of_random_edits(how):
    """At the allowed distance, with replacements, insertions and deletions."""
    rng = random.Random(how)
    hit = total = 0
    for n in (8, 14, 30, 57, 120, 300, 900):
        items = [(i, [f"w{rng.randrange(3000)}" for _ in range(n)]) for i in range(24 if n < 300 else 8)]
        texts, k = [], decontaminate.allowed(n)
        for _, words in items:
            at = set(range(k) if how == "front" else range(n - k, n) if how == "back" else rng.sample(range(n), k))
            edited = [y for i, x in enumerate(words) for y in (rng.choice([[], [x, "new"], ["other"]]) if i in at else [x])]
            texts.append([f"q{i}" for i in range(30)] + edited + [f"q{i}" for i in range(30)])
        found = decontaminate.Index(items).search(texts)
        hit, total = hit + sum(i in found[i] for i, _ in items), total + len(items)
    assert hit >= 0.97 * total


def test_decontamination_is_not_quadratic_in_shared_phrases():
    """N items of 24 words share a phrase of 8; N texts hold it among words of the benchmark."""

    def proposed(n: int) -> int:
        rng = random.Random(5)
        phrase = [f"p{i}" for i in range(8)]
        items = [(i, phrase + [f"w{16 * i + j}" for j in range(16)]) for i in range(n)]
        some = lambda k: [f"w{rng.randrange(16 * n)}" for _ in range(k)]
        texts = [some(20) + phrase + some(20) for _ in range(n)]
        index = decontaminate.Index(items)
        assert all(i in f for (i, _), f in zip(items[:40], index.search([w for _, w in items[:40]])))
        index.proposed = 0
        index.search(texts)
        return index.proposed

    few, more, most = proposed(200), proposed(400), proposed(800)
    assert more <= 2.2 * few + 200 and most <= 2.2 * more + 400


def test_decontamination_loses_nothing_that_shared_keys_alone_propose(monkeypatch):
    """With few walks, edits in an item's own words often leave the keys of its shared phrase alone; what
    those propose is found as if no key were shared."""
    rng = random.Random(3)
    phrase = [f"p{i}" for i in range(9)]
    items = [(i, phrase + [f"w{16 * i + j}" for j in range(9)]) for i in range(60)]
    texts = []
    for _, words in items * 4:
        edited = list(words)
        for p in rng.sample(range(9, 18), decontaminate.allowed(18)):
            edited[p] = "other"
        texts.append(["q"] * 9 + edited + ["q"] * 9)
    got = decontaminate.Index(items, repetitions=5)
    found = got.search(texts)
    monkeypatch.setattr(decontaminate, "SHARED", 10**9)
    every = decontaminate.Index(items, repetitions=5)
    assert found == every.search(texts) and sum(map(len, found)) > 150 and got.proposed < every.proposed


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "null id"), (1, "null id"), (2, "tie tie"), (3, ""), (4, None), (None, "one")], "item_id long, text string")
    out = decontaminate.find_items(with_extra(spark, odd_texts()), bench).collect()
    assert len(out) == 10
    assert [r["item_ids"] for r in out if r["doc_id"] is None] == [[1]] and all(r["item_ids"] == [2] for r in out if r["doc_id"] == 7)
    assert not any(r["contaminated"] for r in out if r["doc_id"] in (1, 2, 3, 4))
    assert decontaminate.find_items(frame(spark, []), bench).count() == 0
    assert decontaminate.find_items(frame(spark, [(1, "x")]), bench.limit(0)).first()["contaminated"] is False


def test_best_match_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 12)) for _ in range(2))
        assert decontaminate.best_match(a, b) == (sellers(a, b) if a else 0)


def test_media_copies(spark):
    vectors = spark.createDataFrame([(i, [float(i % 37), 1.0, float(i % 37) / 3]) for i in range(60)], "vec_id long, embedding array<float>")
    media = media_copies.media_of(vectors, every=2)
    odd = spark.createDataFrame([(9001, None), (9002, b""), (9003, b"junk"), (9004, b"junk"), (None, b"junk")], "media_id long, image binary")
    out = {r["media_id"]: r for r in media_copies.image_copies(media.unionAll(odd).withColumn("id", F.lit("x"))).collect()}
    first = {m: 2 * ((m // 2) % 37) for m in out if m is not None and m < 9000}
    edited = [m for m in first if m % 2]
    assert all(out[m]["component_id"] == first[m] for m in first if not m % 2)
    assert np.mean([out[m]["component_id"] == first[m] for m in edited]) >= 0.95
    assert all(out[m]["component_id"] in (m, first[m]) for m in edited)
    assert out[9004]["component_id"] == 9003 and out[9001]["kept"] and out[9002]["kept"] and out[None]["kept"]
    assert media_copies.image_copies(odd.limit(0)).count() == 0


def all_pairs_of(rows, least=media_copies.CONSENSUS):
    """Brute force: every pair of images held against each other; links and components."""
    known = {i: media_copies.describe(g) if (g := media_copies.decode_image(x)) is not None else (np.empty((0, 2)), np.empty((0, 4), np.int64)) for i, x in rows}
    links = {(a, b) for a in known for b in known if a < b and media_copies.consensus(known[a][0].astype(float), known[a][1], known[b][0].astype(float), known[b][1], least) >= least}
    parent = {i: i for i in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(links):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return links, {i: find(i) for i in known}


@pytest.mark.parametrize("meet", [media_copies.MEET, 2])
def test_media_copies_against_all_pairs(spark, monkeypatch, meet):
    """Small groups of keys, and (meet = 2) groups that are held against one image and then by pairs of keys."""
    monkeypatch.setattr(media_copies, "MEET", meet)
    rows = []
    for k in range(24):
        whole = media_copies.picture([float(k), 2.0])
        rows.append((10 * k, media_copies.encode_png(whole)))
        rows += [(10 * k + j, media_copies.encode_png(media_copies.edited(whole, 31 * k + j))) for j in range(1, 4)]
    links, want = all_pairs_of(rows)
    got = {r["media_id"]: r["component_id"] for r in media_copies.image_copies(spark.createDataFrame(rows, "media_id long, image binary")).collect()}
    joined = [got[a] == got[b] for a, b in links]
    assert len(links) > 60 and np.mean(joined) >= 0.95
    assert all(want[i] == want[j] for i in got for j in got if got[i] == got[j])


@pytest.mark.parametrize(("meet", "tags"), [(1, 64), (4, 64), (4, 3)])
def test_media_copies_of_large_groups_lose_no_pair(spark, monkeypatch, meet, tags):
    """Every pair with two common keys and a consensus is in one component, however many images have the keys."""
    monkeypatch.setattr(media_copies, "MEET", meet)
    monkeypatch.setattr(media_copies, "TAGS", tags, raising=False)
    whole = [media_copies.picture([float(k), 5.0]) for k in range(6)]
    rows = [(20 * k + j, media_copies.encode_png(media_copies.edited(a, 17 * k + j) if j else a)) for k, a in enumerate(whole) for j in range(12)]
    links, _ = all_pairs_of(rows)
    keys = {}
    for i, x in rows:
        single = np.unpackbits(media_copies.describe(media_copies.decode_image(x))[1].view(np.uint8), axis=1)
        keys[i] = {(t, b[pick[:56]].tobytes()) for b in single for t, pick in enumerate(media_copies.PICKS)}
    voted = [(a, b) for a, b in links if len(keys[a] & keys[b]) >= 2]
    parent = {i: i for i in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(voted):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["media_id"]: r["component_id"] for r in media_copies.image_copies(spark.createDataFrame(rows, "media_id long, image binary")).collect()}
    assert len(voted) > 250 and got == {i: find(i) for i in keys}


def test_media_copies_with_repeated_ids(spark):
    a, b = (media_copies.encode_png(media_copies.picture([float(k), 3.0])) for k in range(2))
    rows = [(5, a), (5, b), (5, None), (4, b), (9, a), (None, a), (None, None), (8, None)]
    got = sorted(((r["media_id"], r["component_id"], r["kept"]) for r in media_copies.image_copies(spark.createDataFrame(rows, "media_id long, image binary")).collect()), key=str)
    assert got == sorted([(5, 4, False)] * 3 + [(4, 4, True), (9, 4, False), (None, None, True), (None, None, True), (8, 8, True)], key=str)


def test_media_of_leaves_out_rows_without_id_or_vector(spark):
    rows = spark.createDataFrame([(1, [1.0]), (None, [1.0]), (2, None)], "vec_id long, embedding array<float>")
    assert [r["media_id"] for r in media_copies.media_of(rows).collect()] == [2]


def test_small_crops_of_large_images():
    large = [media_copies.picture([float(k), 1.0], 400) for k in range(3)]
    whole = [media_copies.describe(a) for a in large]
    assert len(whole[0][0]) > 800
    for k, a in enumerate(large):
        for y, x in ((150, 120), (20, 260), (290, 40)):
            crop = media_copies.describe(a[y : y + 100, x : x + 100] * 0.9 + 5)
            votes = [media_copies.consensus(*w, *crop) for w in whole]
            assert votes[k] >= media_copies.CONSENSUS > max(v for j, v in enumerate(votes) if j != k)


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (6, 5, 3)).astype(np.int64)
    raw = b""
    for y in range(6):
        kind, line = y % 5, []
        up = rgb[y - 1].reshape(-1) if y else np.zeros(15, int)
        row = rgb[y].reshape(-1)
        for i, v in enumerate(row):
            a, b, c = (row[i - 3] if i > 2 else 0), up[i], (up[i - 3] if i > 2 else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        raw += bytes([kind, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = media_copies.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    np.testing.assert_allclose(media_copies.decode_image(png), rgb.mean(2))
    assert media_copies.decode_image(png[:40]) is None and media_copies.decode_image(b"P5 2 1 255\n\x01\x02").tolist() == [[1.0, 2.0]]


def test_helper_columns_do_not_clash(spark):
    rows = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (None, "x")]).select("*", *[F.lit(n).alias(n) for n in ("kept", "nth", "_kept", "found", "_found", "__found")])
    one = near_dedup.keep_one(rows)
    assert one.columns == rows.columns and one.count() == 2 and one.first()["__found"] == "__found"
    found = decontaminate.find_items(rows, spark.createDataFrame([(7, "c d e")], "item_id long, text string"))
    assert found.columns == [*rows.columns, "item_ids", "distance", "contaminated"] and found.where("contaminated AND __found = '__found'").count() == 2


def pipeline_tables(spark, path, docs, labels, bench):
    for name, data, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        df = data if not isinstance(data, list) else spark.createDataFrame(data, schema)
        df.write.parquet(f"{path}/{name}.parquet")


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    pipeline_tables(spark, tmp_path / "none", [], [], [])
    assert C.run(spark, str(tmp_path / "none")).count() == 0
    # Without labels the classifier scores 0.5 and keeps nothing.
    pipeline_tables(spark, tmp_path / "unlabelled", [(1, "some text", "en", "s", 9)], [], [])
    assert C.run(spark, str(tmp_path / "unlabelled")).count() == 0


def test_pipeline_stages_bear_nulls_ties_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as C

    rows = [(i, t, None, None, None) for i, t in odd_texts()] + [(50 + i, f"word{i} " * 5 + "here", "en", "s", 30) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(n).alias(n) for n in ("kept", "found", "lines", "score", "n_removed", "contaminated")])
    labels = [(50 + i, 1, 0) for i in range(20)] + [(None, 1, 0), (5, None, None), (7, 1, 0), (7, 1, 0)]
    pipeline_tables(spark, tmp_path, docs, labels, [(1, "null id"), (None, "x"), (2, None), (2, "")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = {r["doc_id"]: r for r in out.collect()}
        assert all(r["found"] == "found" and r["score"] == "score" for r in kept.values()) and {50 + i for i in range(20)} <= set(kept)
    assert None not in {r["doc_id"] for r in C.benchmark_leaks(spark, docs, str(tmp_path)).collect()}
    assert sum(r["doc_id"] == 7 for r in C.near_copies(spark, docs, str(tmp_path)).collect()) == 1
    assert C.tokens(spark, docs, str(tmp_path)).count() == len(rows)


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    rows = [(i, text(rng.randint(20, 90)), "en", "s", 1) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(5)] + [(110 + i, "!! " + " ".join(f"{w.upper()}!!" for w in rng.choices(words, k=60)), "en", "s", 1) for i in range(30)]
    bench = [(1, text(30))]
    rows += [(200, text(20) + " " + bench[0][1], "en", "s", 1), (201, None, "en", "s", None)]
    for name, data, schema in (("documents", rows, DOCS), ("labels", [(r[0], int(not (110 <= r[0] < 140)), 0) for r in rows], "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r["doc_id"] for r in C.quality(spark, docs, str(tmp_path)).collect()}
    assert not kept & set(range(110, 140)) and kept >= set(range(80))
    out = {r["doc_id"]: r for r in C.run(spark, str(tmp_path)).collect()}
    after = brute_lines([(r[0], r[1]) for r in rows if r[0] in kept], 50)
    left = [(i, t) for i, (t, n) in after.items() if not (n and not t.strip())]
    groups, _ = brute_components(left, 5)
    leaks = {i for i, t in left if sellers(decontaminate.words_of(bench[0][1]), decontaminate.words_of(t)) <= 6}
    want = {i: t for i, t in left if groups[i] == i and i not in leaks}
    assert 200 in leaks and set(out) == set(want)
    assert all(out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in want.items())


def warc_rows(n: int) -> list[dict]:
    return [{"record_id": f"urn:{i}", "record_type": "response", "target_uri": f"http://x/{i}", "payload": f"body {i} ".encode() * 50} for i in range(n)]


def warc_read(data: bytes, need: bool = True) -> list:
    import io

    return [(h.get("WARC-Record-ID", h.get("X-Reason")), b) for h, b in warc.records_of(io.BytesIO(data), lambda h: True, need)]


@pytest.mark.parametrize("kind", ["own", "gzip", "plain"])
def test_warc_damaged_archives(kind):
    """Every good record is read, and each bad one is told."""
    import gzip

    packed = {"own": warc.member, "gzip": gzip.compress, "plain": lambda x: x}[kind]
    parts = [packed(warc.record(r)) for r in warc_rows(5)]
    ids = [f"<urn:{i}>" for i in range(5)]
    whole = warc_read(b"".join(parts))
    assert [i for i, _ in whole] == ids and all(b for _, b in whole)
    for need in (True, False):
        cut = warc_read(b"".join(parts)[:-20], need)
        assert [i for i, _ in cut][:4] == ids[:4] and len(cut) == 5 + (kind == "gzip" and cut[4][0] == ids[4]) and cut[-1][0] not in ids
        if kind != "plain":
            hurt = bytearray(parts[2])
            hurt[len(hurt) // 2 : len(hurt) // 2 + 4] = b"\xff\x00\xff\x00"
            got = [i for i, _ in warc_read(b"".join([*parts[:2], bytes(hurt), *parts[3:]]), need)]
            assert [i for i in got if i in ids and i != ids[2]] == [ids[0], ids[1], ids[3], ids[4]]
            assert not need or any(i not in ids for i in got)
        for bad in (b"Content-Length: x5059", b"Content-Length: ", b"Content-Length: -3", b"X-Other: 1"):
            changed = packed(re.sub(rb"Content-Length: \d+", bad, warc.record(warc_rows(5)[2])))
            got = [i for i, _ in warc_read(b"".join([*parts[:2], changed, *parts[3:]]), need)]
            assert got == [ids[0], ids[1], "no usable Content-Length", ids[3], ids[4]]
        lf = [packed(warc.record(r).replace(b"\r\n", b"\n", warc.record(r).partition(b"\r\n\r\n")[0].count(b"\r\n") + 2)) for r in warc_rows(5)]
        assert [i for i, _ in warc_read(b"".join(lf), need)] == ids
    junk = [i for i, _ in warc_read(b"".join([parts[0], b"some junk\nhere" * 9, *parts[1:]]))]
    assert [i for i in junk if i in ids] == ids and len(junk) == 6
    assert warc_read(b"") == [] and len(warc_read(b"junk" * 1000)) == 1


def test_warc_damaged_rows_are_counted(spark, tmp_path):
    good = [warc.member(warc.record(r)) for r in warc_rows(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(good)[:-30])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(good))
    spark.dataSource.register(warc.WarcSource)
    read = lambda **o: spark.read.format("warc").options(**o).load(str(tmp_path))
    assert read().count() == 7
    assert read(damaged="rows").groupBy("record_type").count().orderBy("record_type").collect() == [("damaged", 1), ("response", 7)]
    assert read(damaged="rows").where("record_type = 'damaged'").select("payload", "headers").first()["headers"]["X-Reason"] == "the member is cut off"


def test_unclosed_titles_in_linear_time():
    import time

    began = time.process_time()
    assert sum(1 for _ in html_crf.tags_of("<title>" * 40_000)) == 40_000
    assert time.process_time() - began < 1
