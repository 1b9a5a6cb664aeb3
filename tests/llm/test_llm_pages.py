"""Page layout, mixing and the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from wardscore.llm import html_render, minhash_dedup, mixing, queries
from wardscore.llm.html_render import render

CASES = {
    "": "",
    "plain   text\n here": "plain text here",
    "<p>One<p>Two <b>bo</b>ld<br>next": "One\n\nTwo bold\nnext",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>": "* a\n* b\n  3. x\n  4. y\n* c",
    "<ol reversed><li>a<li value=7>b<li>c</ol>": "3. a\n7. b\n6. c",
    "<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td>é<td>x</table>": "Name       Qty\nApple pie  3\né          x",
    "<table><tr><td colspan=2>wide one<td>z<tr><td>a<td>b<td>c</table>": "wide one  z\na  b      c",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>": "日本   x\nabcde  y",
    "<td>x<td>y": "x\ny",
    "a<script>b<p></script><style>c</style><!-- d --><template>e</template>f": "af",
    "<div hidden>a</div><p style='DISPLAY : none'>b</p><span style='visibility:hidden'>c</span>d": "d",
    "<head><title>t</title><body>x": "x",
    "<pre> a\n   b</pre>c": " a\n   b\n\nc",
    "<blockquote>q<p>r</blockquote>": "    q\n\n    r",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>": "s\nt\nyes",
    "<select><option>1<option selected>2</select>": "2",
    "&lt;b&gt; &amp;&copy; &#233;": "<b> &© é",
    "</p></div></table>x</b>": "x",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n    d\nu",
    "<h1>h</h1>x<hr>y": "h\n\nx\n---\ny",
}


@pytest.mark.parametrize("page", list(CASES))
def test_layout(page):
    assert render(page) == CASES[page]


STRAY = {
    "<table><tr>text<td>a</table>": "text\na",
    "<table><tr><form><td>a</td><td>b</td></form></tr><tr><td>cc<td>d</table>": "a   b\ncc  d",
    "<table><form style='display:none'><tr><td>a<td>b</form></table>": "a  b",
    "<table><tr><font>x<td>a</td>y</font><p>z</p></tr></table>": "xy\n\nz\na",
    "<table><tr hidden>text<td>a</tr><tr><td>b</table>": "b",
    "<table><tr><td>a<table><tr><td>i</table></table>": "a\n\ni",
    "a <svg><defs/><title>t</title><path d='M0'/><text>one</text><text>two</text><desc>no</desc></svg>b": "a one two b",
    "<svg><defs><text>no</text></defs></svg><math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>no</annotation></math>": "x+1",
    "<select multiple><option>1<option selected>2<optgroup label=g><option>3</select>": "1\n2\ng\n3",
    "<select size=3><option>1<option>2</select>": "1\n2",
}


@pytest.mark.parametrize("page", list(STRAY))
def test_all_visible_text_is_kept(page):
    assert render(page) == STRAY[page]


LOST = {
    "<head><title>T</title><span>visible</span> text": "visible text",
    "<head><title>T</title>plain text<p>para": "plain text\n\npara",
    "<html><head><meta charset=utf-8><script>x</script>\n<a href=x>link</a></head><body>b": "link\nb",
    "<input type=email value=a><input type=number value=1><input type=search value=s><input type=date value=d><input type=checkbox value=no><input type=password value=no>": "a1sd",
    "<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b><hr><ul><li>no</ul></div>z": "yes\nz",
    "<p style='visibility:hidden'>no<input value=no></p>z": "z",
    "a<!-- never closed <p>no</p>": "a",
    "a<b>b</b><a href='x": "ab",
    "<div>" * 160 + "<div hidden><p>HIDDEN</p>more<p>HIDDEN</div>shown": "shown",
    "<div>" * 160 + "a<b>b</b>c" + "</div>" * 160 + "<div hidden>no</div>d": "a\nb\nc\nd",
}


@pytest.mark.parametrize("page", list(LOST))
def test_what_browsers_show_and_hide(page):
    assert render(page) == LOST[page]


def test_random_trees_keep_exactly_the_visible_words():
    import random

    draw = random.Random(11)
    looks = ["", "", "", " hidden", " style='display:none'", " style='visibility:hidden'", " style='visibility:visible'"]

    def tree(depth, shown, gone):
        """Markup, and the words that show."""
        text, words = "", []
        for _ in range(draw.randint(1, 3)):
            if depth == 0 or draw.random() < 0.4:
                word = f"w{draw.randrange(10**9)}"
                text += f" {word} "
                words += [word] if shown and not gone else []
            else:
                tag, look = draw.choice(["div", "p", "span", "b", "section", "blockquote"]), draw.choice(looks)
                now = False if "hidden'" in look else True if "visible'" in look else shown
                inner, found = tree(depth - 1, now, gone or look in (" hidden", " style='display:none'"))
                inner = inner if tag != "p" else "".join(c for c in inner.split("<")[:1])
                found = found if tag != "p" else [w for w in found if w in inner]
                text += f"<{tag}{look}>{inner}</{tag}>"
                words += found
        return text, words

    for _ in range(400):
        page, words = tree(4, True, False)
        assert render(page).split() == words


def test_unfinished_tags_take_linear_time():
    import time

    start = time.perf_counter()
    assert render("x" + "<a " * 350_000) == "x"
    assert render("y<!-- " * 200_000) == "y"
    assert time.perf_counter() - start < 5


def test_layout_of_deep_and_long_pages():
    assert render("<div>" * 5000 + "deep") == "deep"
    assert render("<table>" * 300 + "<tr><td>x" * 300).count("x") == 300
    assert len(render("<p>word word" * 20_000)) > 180_000


def test_extract_text_edges(spark):
    pages = spark.createDataFrame([(1, None, "c"), (1, "<p>a", "c"), (None, "b", "c")], "page_id long, html string, text string")
    assert sorted(r["text"] for r in html_render.extract_text(pages).collect()) == ["", "a", "b"]
    assert html_render.extract_text(pages.limit(0)).count() == 0


def test_given_pages_keep_their_article(spark, sf_dir):
    rows = {r["page_id"]: r["text"] for r in html_render.query(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(pages)
    assert all("track(" not in rows[p["page_id"]] and "©" in rows[p["page_id"]] for p in pages if "&copy;" in p["html"])


def test_rake_meets_targets():
    draw = np.random.default_rng(3)
    tokens = draw.integers(1, 1000, 60).astype(float)
    places = [np.arange(60) % 5, np.arange(60) // 15]
    own = [np.bincount(p, tokens) / tokens.sum() for p in places]
    targets = [o**0.8 / (o**0.8).sum() for o in own]
    chance = mixing.rake(tokens, places, targets, 0.6)
    assert chance.max() <= 1 and chance.min() >= 0
    for place, target in zip(places, targets, strict=True):
        assert np.allclose(np.bincount(place, tokens * chance) / (0.6 * tokens.sum()), target, atol=1e-6)


def test_reachable_fills_up():
    assert np.allclose(mixing.reachable(np.array([0.5, 0.5]), np.array([10.0, 90.0]), 60.0), [10, 50])


def mix_rows(spark):
    rows = [(i, "a b c" if i % 3 else "Copyright x", "en" if i % 4 else None, f"s{i % 3}", "x", 1.0) for i in range(4000)]
    rows += [(None, None, "fr", None, "x", 1.0), (1, "", "fr", "s0", "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _cell string, mix double")


def test_mixing(spark):
    docs = mix_rows(spark)
    topic = mixing.F.lit("any")
    got = mixing.mixed(docs, topic=topic, targets={"source": {"s0": 0.3, "s1": 0.4}}, name="m").select("doc_id", "source", "m.*").toPandas()
    assert len(got) == 4002
    expected = (got["tokens"] * got["probability"]).groupby(got["source"].fillna("none")).sum()
    assert np.allclose(expected / expected.sum(), expected.index.map({"none": 0, "s0": 0.3, "s1": 0.4, "s2": 0.3}), atol=1e-6)
    drawn = got[got["sampled"]]["tokens"].sum() / got["tokens"].sum()
    assert abs(drawn - mixing.BUDGET) < 0.03
    sample = mixing.sample(docs)
    assert sample.columns == docs.columns
    assert {tuple(r) for r in sample.collect()} == {tuple(r) for r in mixing.sample(docs.repartition(5)).collect()}
    assert mixing.mixed(docs.limit(0), name="m").count() == 0


def test_mixing_keeps_every_given_target(spark):
    """Targets of many sources, the rarest among them."""
    docs = spark.createDataFrame([(i, "a b", "en", f"s{i % 40}") for i in range(2000)], "doc_id long, text string, lang string, source string")
    wished = {f"s{i}": (2.0 if i % 2 else 0.5) / 50 for i in range(40)}
    got = mixing.mixed(docs, topic=mixing.F.lit("any"), targets={"source": wished}, budget=0.4, name="m").select("source", "m.*").toPandas()
    expected = (got["tokens"] * got["probability"]).groupby(got["source"]).sum()
    assert np.allclose(expected / expected.sum(), expected.index.map(wished), atol=1e-9)


def plain_chances(rows, given, temper, budget):
    """Raking of {cell: tokens} by loops, one margin after the other, no probability above one."""
    total = sum(rows.values())
    wishes = []
    for place in range(3):
        own = {}
        for cell, n in rows.items():
            own[cell[place]] = own.get(cell[place], 0) + n
        goal = {v: (n / total) ** temper for v, n in own.items()} if place or given is None else {v: given[v] for v in own}
        full = set()
        while True:
            left = total * budget - sum(own[v] for v in full)
            wide = sum(g for v, g in goal.items() if v not in full)
            wish = {v: own[v] if v in full else goal[v] / wide * left for v in own}
            over = {v for v in own if v not in full and wish[v] > own[v]}
            if not over:
                break
            full |= over
        wishes.append(wish)
    chance = dict.fromkeys(rows, budget)
    for _ in range(300):
        for place, wish in enumerate(wishes):
            for _ in range(30):
                have = dict.fromkeys(wish, 0.0)
                for cell, n in rows.items():
                    have[cell[place]] += n * chance[cell]
                chance = {c: min(1, p * wish[c[place]] / have[c[place]]) if have[c[place]] else p for c, p in chance.items()}
    return chance


@pytest.mark.parametrize(("cells", "wished"), [(mixing.DRIVER_CELLS, False), (mixing.DRIVER_CELLS, True), (0, False)])
def test_mixing_equals_plain_raking(spark, monkeypatch, cells, wished):
    """Cells, topics, probabilities and draws computed again, with the cells on the driver and as a table."""
    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
    draw = np.random.default_rng(6)
    signs = {"License": "legal", "token =": "secrets", "@": "contact", "|": "table", "#": "marked", "plain": "prose"}
    rows = []
    for i in range(600):
        sign = list(signs)[int(draw.integers(0, 6))]
        rows.append((i, " ".join(["w"] * int(draw.integers(1, 9)) + [sign]), ["en", "de", None][int(draw.integers(0, 3))], f"s{int(draw.integers(0, 9)) ** 2 % 7}", sign))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tag string")
    given = {f"s{k}": w for k, w in zip((0, 1, 2, 4), (0.1, 0.2, 0.3, 0.4), strict=True)} if wished else None
    got = mixing.mixed(docs, targets={"source": given} if wished else None, budget=0.5, name="m").select("doc_id", "m.*").collect()
    sums = {}
    for _, text, lang, source, sign in rows:
        cell = (source, lang, signs[sign])
        sums[cell] = sums.get(cell, 0) + len(text.split())
    chances = plain_chances(sums, given, mixing.TEMPER, 0.5)
    assert len(got) == 600
    for r in got:
        _, text, lang, source, sign = rows[r["doc_id"]]
        assert (r["tokens"], r["topic"]) == (len(text.split()), signs[sign])
        assert abs(r["probability"] - chances[source, lang, signs[sign]]) < 1e-5 and abs(r["weight"] - 2 * r["probability"]) < 1e-12
    shares = docs.select("doc_id", (mixing.F.shiftrightunsigned(mixing.F.xxhash64("doc_id", mixing.F.lit(0)), 11) / 2.0**53).alias("u"))
    u = {r["doc_id"]: r["u"] for r in shares.collect()}
    assert all(r["sampled"] == (u[r["doc_id"]] < r["probability"]) for r in got)


def test_two_thousand_sources_meet_their_targets(spark):
    """Without given targets every source has a margin of its own, also the rare ones."""
    docs = spark.range(12_000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 7 as int)) text", "if(id % 3 = 0, 'en', 'de') lang", "concat('s', id % 2000) source")
    got = mixing.mixed(docs, name="m").select("source", "m.*").toPandas()
    own = got["tokens"].groupby(got["source"]).sum()
    expected = (got["tokens"] * got["probability"]).groupby(got["source"]).sum()
    wished = mixing.reachable((own / own.sum()).to_numpy() ** mixing.TEMPER, own.to_numpy(float), mixing.BUDGET * own.sum())
    assert len(own) == 2000 and np.allclose(expected.to_numpy(), wished, rtol=1e-6)


def test_table_of_cells_is_raked_like_arrays(spark):
    """A given target above what there is, a value it does not name, probabilities cut to one."""
    cells = [("=a", "?", "=x", 10), ("=b", "?", "=x", 60), ("=c", "?", "=x", 20), ("*", "?", "=x", 30)]
    table = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    given = {"source": {"a": 0.5, "b": 0.3, "c": 0.1}}
    got = {r["source"]: r["chance"] for r in mixing.rake_table(table, given, 0.9, 0.5).collect()}
    wished = mixing.rake_arrays(table.collect(), given, 0.9, 0.5)
    assert got["=a"] == 1
    assert all(abs(got[c[0]] - p) < 1e-5 for c, p in zip(cells, wished, strict=True))


def test_mixing_tables_of_no_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", -1)
    assert mixing.mixed(mix_rows(spark).limit(0), name="m").count() == 0
    nothing = spark.createDataFrame([(1, None, None, None), (2, "", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r["probability"] for r in mixing.mixed(nothing, name="m").select("m.*").collect()} == {mixing.BUDGET}


def test_queries_and_pipeline_stages(spark, sf_dir):
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 14))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        docs = corpus_pipeline.land(stage(spark, docs, sf_dir), name)
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name == "quality":
            told = [(i in kept[0]) == bool(q) for i, q in labels.items()]
            assert sum(told) / len(told) > 0.97
        if name == "near_dedup":
            marks = minhash_dedup.near_duplicates(spark.createDataFrame(list(before.items()), "doc_id long, text string"))
            assert kept[1] == {r["doc_id"] for r in marks.where("kept").collect()}
        assert docs.columns == (columns if name != "bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
    assert kept[3] == kept[2] < kept[1] < kept[0]


def test_pipeline_edges(spark, tmp_path):
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, d1 long, ids string, mix int, __row int, `a.b` int"
    for rows in ([], [(None,) * 11, (1, "a b", *(None,) * 7, 7, 8), (1, "a b", *(None,) * 7, 7, 8)]):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = corpus_pipeline.land(stage(spark, docs, str(tmp_path)), name)
            assert name == "bpe" or docs.columns == columns
            assert name == "bpe" or {(r["__row"], r["a.b"]) for r in docs.collect()} <= {(None, None), (7, 8)}
        assert docs.count() <= len(rows)
