import math
import random

import numpy as np
from pyspark.sql import functions as F

from longweft.llm import ann, html_text, langid, quality_rules, toxicity
from longweft.llm.common import fold
from longweft.llm.queries import op4_toxicity, op10_langid

SF = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    got = op10_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 10_000 and (held.lang == held.lang_pred).mean() > 0.99 and got.score.between(0, 1).all() and got.rejected.mean() < 0.01


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(1, "the and of", "en", "q"), (2, "der und die", "de", "q"), (2, "der und die", "de", "q"), (3, None, "en", "q"), (4, "12 !", "de", "q"), (None, "and the", None, "q"), (5, "and " * 400_000, "en", "q"), (6, "½ ² ① Ⅷ", "en", "q")], "doc_id long, text string, lang string, score string")
    m = langid.train(df)
    got = langid.identify(df, m, ("doc_id", "score")).collect()
    assert len(got) == 8 and {r.lang_pred for r in got if r.doc_id in (3, 4, 6)} == {"und"} and all(r.lang_pred in ("en", "de") for r in got if r.doc_id in (1, 2, 5))
    none = langid.train(df.limit(0))
    assert [r.lang_pred for r in langid.identify(df, none).collect()] == ["und"] * 8 and langid.identify(df.limit(0), m).count() == 0


def test_toxicity_held_out(spark):
    got = op4_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    held = got[got.held_out]
    p, n = held.score[held.toxic == 1].values, held.score[held.toxic == 0].values
    assert ((p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None])).mean() > 0.93 and (p >= 0.3).mean() > 0.8 and (n >= 0.3).mean() < 0.1


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, "fine words", "x"), (2, None, "x"), (2, None, "x"), (None, "a", "x"), (3, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 1), (None, 1), (9, 1)], "doc_id long, toxic int")
    for l in (labels, labels.limit(0), labels.filter("toxic = 0")):
        got = toxicity.score(docs, toxicity.train(docs, l), ("doc_id", "score")).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)


def test_non_negative_risk_learns_from_unlabelled():
    rng = np.random.default_rng(0)
    pos = [np.array([0, *rng.integers(2, 30, 5)]) for _ in range(200)]
    unl = [np.array([0 if i % 10 == 0 else 1, *rng.integers(2, 30, 5)]) for i in range(2000)]
    w, b = toxicity.fit(pos, unl, 30, prior=0.1)
    assert w[0] + b > 0 > w[1] + b


def test_toxicity_does_not_depend_on_the_layout(spark):
    docs, labels = spark.read.parquet(f"{SF.replace('0.1', '0.01')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.1', '0.01')}/labels.parquet")
    found = []
    for parts in (1, 4, 13):
        dealt = docs.repartition(parts, F.rand(parts))
        scored = toxicity.score(docs, toxicity.train(dealt, labels.repartition(parts)))
        found.append(sorted(map(tuple, scored.collect())))
    assert found[0] == found[1] == found[2] and len({s for _, s in found[0]}) > 100


def brute_risk(w, pos, unl, prior):
    """The two terms of the risk, text by text: prior R_p(+), and R_u(-) - prior R_p(-)."""
    logit = lambda d: sum(w[i] for i in d) + w[-1]
    lost = lambda x: math.log1p(math.exp(x))
    mean = lambda values: sum(values) / len(values)
    return prior * mean([lost(-logit(d)) for d in pos]), mean([lost(logit(d)) for d in unl]) - prior * mean([lost(logit(d)) for d in pos])


def test_each_step_descends_the_non_negative_risk():
    rng, seen = np.random.default_rng(3), set()
    for prior in (0.1, 0.9):
        pos, unl = ([np.unique(rng.integers(0, 6, 3)) for _ in range(n)] for n in (7, 11))
        unl[0] = np.zeros(0, np.int64)
        for _ in range(6):
            w = rng.normal(0, 2, 7)
            a, b = brute_risk(w, pos, unl, prior)
            seen.add(b >= 0)
            risk = (lambda v: sum(brute_risk(v, pos, unl, prior))) if b >= 0 else (lambda v: -brute_risk(v, pos, unl, prior)[1])
            slope = [(risk(w + e) - risk(w - e)) / 2e-6 for e in np.eye(7) * 1e-6]
            assert np.allclose(slope, toxicity.step(w, toxicity._flat(pos), toxicity._flat(unl), prior), atol=1e-5)
    assert seen == {True, False}


def test_toxicity_scores_are_the_model_text_by_text(spark):
    known = sorted({h for w in ("idiot", "réeuxment") for h in toxicity.features(w)})
    model = toxicity.Model(np.array(known, dtype=np.int64), np.linspace(-1, 1, len(known)), -0.5, 0.1)
    rows = [(1, "an Idiot, idiotic!"), (2, "réeuxment " * 200_000), (3, ""), (4, None), (5, "IDIOT\nidiot")]
    for doc_id, got in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        has = {h for w in (dict(rows)[doc_id] or "").split() for h in toxicity.features(w)}
        want = 1 / (1 + math.exp(-(model.bias + sum(w for h, w in zip(known, model.weights) if h in has))))
        assert math.isclose(got, want, abs_tol=1e-12)


def test_fold_is_the_crc_of_the_id_as_text(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 3 for r in df.select("doc_id", fold(df.doc_id, 3).alias("f")).collect())


def brute_quality(t):
    import re
    from collections import Counter

    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality_measures_match_brute_force(spark):
    rng = random.Random(6)
    texts = ["", " ", "\n\n", "a b", "é🙂 #|<", "x\ny\nx\n \nx", "same words here again and more to come now " * 9, "a " * 30_000]
    texts += ["".join(rng.choice("ab \n\t#|") for _ in range(rng.randrange(400))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, None, "c"), (1, " ", "c")], "doc_id long, text string, n_words string")
    got = quality_rules.quality_rules(df, ("doc_id", "n_words")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute_quality(texts[r.doc_id] if r.doc_id is not None else "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_quality_is_native(spark):
    plan = quality_rules.quality_rules(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_html_blocks():
    b = lambda p: html_text.blocks(p)[0]
    assert b("<nav>m</nav><article><header><h1>T &amp; t</h1></header><p>a <b>b</b>c<br>d<p class='ad'>x<p>e<div class=comments><p>z</div></article><footer>f") == ["T & t", "a bc d", "e"]
    assert b("<div class=ad>never closed<p>text") == ["never closed", "text"]
    assert b("<main><p>m</p></main><p>n") == ["m"] and b("") == [] and b("a < b <i>c") == ["a < b c"]
    assert b("<script>var t='</p>';</script><style>p{}</style><p>x<!-- <p>no --> y<form><p>q</form>") == ["x y"]


def test_html_hosts_without_containers(spark):
    page = lambda i: f"<html><body><div>One two three four five six seven eight nine</div><p>At {i}, own words of page {i} and no other, {i * i} in all</p></body>"
    rows = [(i, "http://h.example/x", page(i)) for i in range(5)] + [(9, None, None), (10, "http://other.example/", page(3)), (10, "http://other.example/", ""), (None, "x", "<article>t</article>")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None and r.page_id < 5:
            assert "One two" not in r.text and f"page {r.page_id}" in r.text and r.n_chars == len(r.text)
    assert {r.text for r in got if r.page_id == 9} == {""} and {r.text for r in got if r.page_id is None} == {"t"}
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_loose_signs_drop_nothing_of_an_article():
    b = lambda p: html_text.blocks(p)[0]
    for sign in ('class="overflow-hidden"', 'id="social-policy"', "id=related-work", "class='x search-method'", 'data-id="search"', 'title="the hidden valley"', "data-x=' hidden '", 'href="/wiki/hidden/x"', 'class="x" class="ad"'):
        assert b(f"<article><div {sign}><p>t</p></div></article>") == b(f"<div {sign}><article>t</article></div>") == ["t"], sign
    for sign in ("hidden", 'a="b" HIDDEN=""', "aria-hidden = true", 'style="display: none"', 'class="x ad"', "id=search", "role='navigation'", 'class="site_footer"'):
        assert b(f"<article><div {sign}><p>x</p></div><p>t</p></article>") == ["t"], sign
    assert b('<div class="overflow-hidden">t</div><div class="site-nav">x</div>') == ["t"]
    assert b("<article><figure><img src=i><figcaption>c</figcaption></figure><p>t</article>") == ["c", "t"]
    assert b('<article data-comment-count="3" class="has-comments">t</article>') == ["t"]
    assert b('<article>t</article><article class="comment-body">x</article><article id="comment_7">y</article>') == ["t"]


def loose_page(words):
    return f"<html><body><div>{words}</div></body></html>"


def test_html_two_pages_of_a_large_host_share_a_footer(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(9))
    foot = "all rights reserved by the house of many words"
    rows = [(i, "http://large.example/", loose_page(own(i) + (f" {foot}" if i in (3, 1700) else ""))) for i in range(2000)]
    rows += [(5000, "http://else.example/", loose_page(f"{own(5000)} {foot}"))]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: own(i) for i in range(2000)} | {5000: f"{own(5000)} {foot}"}


def test_html_copies_of_a_page_are_no_other_page(spark):
    own = "these are the eleven words that only this one page has"
    menu = "home news sport weather travel shop help jobs contact"
    rows = [(1, "http://h.example/a", loose_page(own))] * 3 + [(2, "http://h.example/b", loose_page(f"{own}<!-- a copy -->"))]
    rows += [(i, "http://m.example/", loose_page(f"{menu} page {i} {own}" if i == 3 else f"{menu} {i}")) for i in (3, 3, 4)]
    got = sorted((r.page_id, r.text) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, own)] * 3 + [(2, own)] + [(3, f"page 3 {own}")] * 2 + [(4, "4")]


def shared_by_brute_force(rows, window=8):
    """Texts of loose pages without the windows of a block that another page of the host, with other tokens, has too."""
    pages = [(page_id, url.split("/")[2], [b.split() for b in html_text.blocks(page)[0]]) for page_id, url, page in rows]
    has = {}
    for _, host, found in pages:
        for b in found:
            for i in range(len(b) - window + 1):
                has.setdefault((host, tuple(b[i : i + window])), set()).add(" ".join(map(" ".join, found)))
    out = []
    for page_id, host, found in pages:
        left = []
        for b in found:
            covered = {j for i in range(len(b) - window + 1) if len(has[host, tuple(b[i : i + window])]) > 1 for j in range(i, i + window)}
            left += [" ".join(t for j, t in enumerate(b) if j not in covered)]
        out.append((page_id, " ".join(t for t in left if t)))
    return sorted(out)


def test_html_suffix_array_is_a_search_for_repeated_substrings(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b", "a\x01", "c.", "dé"])
    passages = [" ".join(word() for _ in range(rng.randint(6, 30))) for _ in range(12)]
    common = "the very same line stands on each and every page of this house"
    rows = []
    for i in range(240):
        parts = [" ".join(word() for _ in range(rng.randint(1, 20))) if rng.random() < 0.6 else rng.choice(passages) for _ in range(4)]
        rows.append((i, f"http://h{i % 3}.example/{i}", "".join(f"<div>{p}</div>" for p in parts) + (f"<p>{common}</p>" * (1 + i % 2) if i % 3 < 2 else "")))
    rows += [(300, "http://h0.example/x", rows[0][2]), (301, "http://h9.example/", f"<p>{common}</p><p>{common}</p>")]
    want = shared_by_brute_force(rows)
    assert any("very same" in t for _, t in want) and sum("very same" in t for _, t in want) == 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "4", "40"):  # the common line goes over several parts of the array
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
        assert sorted((r.page_id, r.text) for r in got.collect()) == want
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_html_windows_end_with_their_block_and_long_pages_are_read_whole(spark):
    menu = "<ul><li>home news sport weather travel shop help jobs contact</li></ul>"
    rows = [(i, f"http://w.example/{i}", f"{menu}<p>body of page {n} own words</p>") for i, n in enumerate(("alpha", "beta"))]
    rows += [(2, "http://s.example/", '<div class="has-sidebar"><p>All the text there is</p></div>'), (3, "http://l.example/1", f"{menu}<p>{'x ' * 300_000}</p>"), (4, "http://l.example/2", menu)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "body of page alpha own words", 1: "body of page beta own words", 2: "All the text there is", 3: ("x " * 300_000).strip(), 4: ""}


def test_html_common_runs_are_a_search_over_all_windows():
    rng = random.Random(8)
    for n in (1, 2, 9, 40):
        line = [" ".join(rng.choice("abc") for _ in range(rng.randint(7, 14))) for _ in range(4)]
        pages = [[rng.choice(line) if rng.random() < 0.7 else " ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(3)] for _ in range(n)]
        has = {}
        for i, page in enumerate(pages):
            for b in page:
                for k in range(len(b.split()) - 7):
                    has.setdefault(" ".join(b.split()[k : k + 8]), set()).add(i)
        assert sorted(html_text.common_runs(pages)) == sorted(r for r, v in has.items() if 2 * len(v) > n)
    assert html_text.common_runs([]) == html_text.common_runs([[], ["too short"]]) == []


def test_html_articles_lose_blocks_that_most_pages_of_the_host_have(spark, monkeypatch):
    notice = "sign up here and get our letter on each and every morning"
    quoted = "a passage that a few of these articles quote from one another"
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    blocks = lambda i: [own(i), *([notice] if i % 3 else []), *([quoted] if i % 4 == 0 else []), *([f"{notice} {own(i)}"] if i == 7 else [])]
    page = lambda found: "<article>" + "".join(f"<p>{b}</p>" for b in found) + "</article>"
    rows = [(i, "http://large.example/", page(blocks(i))) for i in range(60)] + [(i, "http://small.example/", page([own(i), notice])) for i in range(100, 119)]
    rows += [(200 + i, "http://copies.example/", page([own(200), quoted])) for i in range(30)] + [(300, "http://large.example/", page([notice]))]
    want = {i: " ".join(b for b in blocks(i) if b != notice) for i in range(60)} | {i: f"{own(i)} {notice}" for i in range(100, 119)}
    want |= {200 + i: f"{own(200)} {quoted}" for i in range(30)} | {300: notice}
    for size in (256, 7):  # one part of the host, and many
        monkeypatch.setattr(html_text, "GROUP", size)
        got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
        assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)


def test_ann_recall_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 30)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    odd = [(2000, None, "s"), (2020, [0.0] * 30, "s"), (2040, [float("nan")] * 30, "s"), (2060, [1.0] * 7, "s"), (None, [1.0] * 30, "s"), (2080, [None] * 30, "s"), (2100, [float("inf")] * 30, "s")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    got = ann.nearest(df).toPandas()
    x, hit = x.astype(np.float64), []
    for q in range(0, 1500, 20):
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in mine.vec_id.tolist()
        s = x @ x[q]
        assert np.allclose(mine.score, s[mine.vec_id]) and mine.score.is_monotonic_decreasing
        best = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        hit.append(len({*best} & {*mine.vec_id}) / 20)
    assert np.mean(hit) >= 0.9 and set(got.query_id) == set(range(0, 1500, 20))
    assert got[got.query_id == 120].vec_id.tolist()[:3] == [100, 101, 102]
    few = ann.nearest(df.filter("vec_id < 3")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2] and ann.nearest(df.limit(0)).count() == 0


def brute_force(x, ids, every=20, k=20):
    out = {}
    for i in ids[ids % every == 0].tolist():
        score = x @ x[np.flatnonzero(ids == i)[0]]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = ids[order].tolist()
    return out


def found_by(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_ann_over_many_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, ids = rng.normal(size=(3000, 10)), np.arange(3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids.tolist(), x)], "vec_id long, embedding array<double>")
    want = brute_force(x, ids)
    monkeypatch.setattr(ann, "ROWS", 400)
    monkeypatch.setattr(ann, "QUERIES", 40)
    assert found_by(ann.nearest(df, reranked=None)) == want
    got = found_by(ann.nearest(df, reranked=60))
    assert set(got) == set(want) and np.mean([len({*got[i]} & {*want[i]}) / 20 for i in want]) >= 0.9


def test_ann_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = df.select("vec_id", "embedding").toPandas()
    want = brute_force(np.array(t["embedding"].tolist(), dtype=np.float64), t["vec_id"].to_numpy())
    assert found_by(ann.nearest(df, reranked=None)) == want
    got = found_by(ann.nearest(df))
    assert np.mean([len({*got[i]} & {*want[i]}) / 20 for i in want]) >= 0.9


def test_ann_recall_where_codes_tell_little(spark):
    rng = np.random.default_rng(4)
    g, ids = rng.normal(size=(6000, 16)), np.arange(6000)
    centres = rng.normal(size=(4, 16))
    near_copies = centres[ids % 4] + 1e-3 * g
    norms = g * np.exp(2 * rng.normal(size=(6000, 1)))
    for x in (near_copies, norms, 1e-12 * near_copies, 1e30 * g):
        x = x.astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids.tolist(), x)], "vec_id long, embedding array<float>")
        want, got = brute_force(x.astype(np.float64), ids), found_by(ann.nearest(df))
        assert set(got) == set(want) and np.mean([len({*got[i]} & {*want[i]}) / 20 for i in want]) >= 0.99


def test_ann_many_rows_of_one_id_leave_room_for_others(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.ones((60, 8)) + rng.random((60, 8)), rng.random((300, 8))])
    ids = [7] * 30 + [20] * 30 + list(range(100, 400))
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "vec_id long, embedding array<double>")
    got = found_by(ann.nearest(df))
    assert all(len(v) == 20 == len({*v}) and i not in v for i, v in got.items()) and 7 in got[20] and set(got) == {20, *range(100, 400, 20)}
