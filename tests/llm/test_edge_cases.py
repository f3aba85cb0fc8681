"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, decontam, fixity, html, langid, linededup, neardup, packing, quality, suffixdedup
from .test_against_brute_force import near_components, quality_numbers, sha, substring_result

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, row string, kept string, label string, hash long"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))
ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "one two three four five six seven eight nine ten eleven twelve", "en", None),
    (3, "one two three four five six seven eight nine ten eleven twelve", "en", None),
    (4, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (None, "a null id has text as well, and it is of some length, more than ten words", None, "a"),
    (None, "a null id has text as well, and it is of some length, more than ten words", None, "a"),
    (5, LONG, "de", "b"),
    (6, LONG + " and more", "de", "b"),
    (7, " \t\r\n \n", "en", "b"),
    (8, "é   \x1c\x1d ß␛c <|end|> </s> 'tis 12 <|endoftext|>", "fr", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, -1, "row", "kept", "label", -2) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame(
        [(1, "Seven EIGHT nine"), (2, None), (3, "..."), (None, "eleven twelve"), (4, "word0x0 word1x1"), (4, "word1x1 word2x2")], "item_id long, text string"
    )
    found = decontam.verdict(decontam.scan(docs, items, ["doc_id", "n_words"]))
    got = [(r["row"]["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in found.collect()]
    assert len(got) == len(ROWS) and all(r["row"]["n_words"] == -1 for r in found.collect())
    assert (1, 0, 0, 0, False) in got and (2, 0, 0, 0, False) in got
    assert got.count((3, 12, 5, 1, True)) == 2 and (4, 12, 5, 1, True) in got
    blocks = decontam.verdict(decontam.scan(docs, items, ["doc_id", "n_words"], block_bytes=20))
    assert sorted(map(str, blocks.drop("row").collect())) == sorted(map(str, found.drop("row").collect()))
    text = {r["row"]["doc_id"]: r["runs"] for r in decontam.scan(docs, items, ["doc_id"]).collect()}
    assert [ROWS[2][1].encode()[a:b] for _, _, a, b in text[3]] == [b"seven eight nine", b"eleven twelve"]
    clean = decontam.clean(docs, items)
    assert clean.columns == docs.columns
    assert decontam.clean(docs, items.where("false")).count() == len(ROWS)
    assert decontam.verdict(decontam.scan(none, items, ["doc_id"])).count() == 0


def test_fixity(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "x"), (2, "u", "text"), (2, "u", "text"), (3, "v", "")], "page_id long, url string, html string")
    table = fixity.manifest(fixity.records(pages))
    assert fixity.audit(table, table).count() == 0
    lost = table.where("page_id is null or page_id <> 3")
    assert [(r["page_id"], r["kind"]) for r in fixity.audit(table, lost, range_bytes=64, fan=2).collect()] == [(3, "missing")]
    assert [(r["page_id"], r["kind"]) for r in fixity.audit(lost, table, range_bytes=64, fan=2).collect()] == [(3, "extra")]
    assert fixity.audit(table.where("false"), table.where("false")).count() == 0


def test_pack(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(docs, path).collect()
    total = sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    assert sum(r["length"] for r in out) == total
    spots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spots, spots[1:], strict=False))
    assert {r["length"] for r in out if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack(none, path).count() == 0


def test_encoder_equals_the_tokenizer():
    import public_tokenizers

    coder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [
        "Don't stop! We'll re-read it, they've said 12 times (1,234.5).",
        "ÉTÉ Straße x y İstanbul ŉ ǅ Ώ é àb",
        "x\x1cy\x1d z\x85w ​",
        "<|endoftext|> a <|startoftext|>b<|endoftext|>",
        "日本語 テキスト 😀😀!! a😀b ''s 's'S",
        "word$$$ other### x*** '%%% A.B.C _under_score_ ~~~",
        "",
        " ",
    ]
    assert coder.encode(texts) == coder.whole(texts)
    assert coder.encode(texts) == coder.whole(texts)


def test_plan_uses_each_piece_once():
    histogram = {2048: 3, 1024: 7, 512: 9, 1536: 4, 32: 100, 5: 40, 31: 9}
    used = {}
    for parts, times in packing.plan(histogram):
        assert sum(k * n for k, n in parts) <= 2048
        for k, n in parts:
            used[k] = used.get(k, 0) + n * times
    assert used == histogram
    assert packing.plan({}) == []


def test_chat(spark):
    texts = ["", "<|end|>", "<|>", "[[INST]]", "␛c␛e␛", "</s><s>", "|>|>", None, "a\nb", "<␛c|"]
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(texts)]
    rows += [(2, None, None, "x"), (2, 5, "end", "y"), (2, 5, "end", "y"), (None, 0, "assistant", "z"), (3, 130, "turn", "q"), (3, 2, "turn|>", "r")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    table = chat.formatted(turns)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(table).collect()}
    assert back[1] == [(r, t or "") for _, _, r, t in rows[: len(texts)]]
    assert back[2] == [("", "x"), ("end", "y"), ("end", "y")] and back[None] == [("assistant", "z")]
    assert back[3] == [("turn|>", "r"), ("turn", "q")]
    n = {r["conv_id"]: r["n_turns"] for r in chat.digests(table).collect()}
    assert n == {1: len(texts), 2: 3, 3: 2, None: 1}
    small = {r["conv_id"]: r["formatted"] for r in chat.formatted(turns, group=2).collect()}
    assert small == {r["conv_id"]: r["formatted"] for r in table.collect()}
    assert chat.digests(chat.formatted(turns.where("false"))).count() == 0


def expected_near(rows, words, percent):
    return near_components(dict(enumerate(r[1] for r in rows)), words, percent)


def test_near_duplicates(spark, docs, none):
    found = neardup.near_duplicates(docs, 3, 85).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    assert len(found) == len(ROWS)
    assert by_id[1] == {(1, True)} and by_id[2] == {(2, True)} and by_id[7] == {(7, True)}
    assert by_id[3] == {(3, True)} and by_id[4] == {(3, False)} and by_id[6] == {(5, False)} and by_id[None] == {(None, False)}
    left = neardup.distinct_documents(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == [(False, i) for i in (1, 2, 3, 5, 7, 8)] + [(True, 0)]
    assert neardup.near_duplicates(none).count() == 0 and neardup.distinct_documents(none).count() == 0


@pytest.mark.parametrize("limits", [{}, {"region_rows": 5, "group_rows": 7}])
def test_near_duplicates_in_a_large_group(spark, limits):
    """Copies around one text, most of them linked to it alone; small limits force the split paths."""
    import random

    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = {0: " ".join(base)}
    for i in range(1, 90):
        words = list(base)
        for _ in range(draw.choice([1, 2, 3, 4, 6, 9])):
            words[draw.randrange(len(words))] = f"v{draw.randrange(10**6)}"
        texts[i] = " ".join(words)
    for i in range(90, 100):
        texts[i] = " ".join(f"u{draw.randrange(10**6)}" for _ in range(60))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 3, 85, **limits).collect()}
    assert found == near_components(texts, 3, 85)


def test_a_row_without_id_is_not_document_0(spark):
    said = "one two three four five six seven"
    texts = [(0, said), (None, said), (4, "other words than the ones before it"), (None, "nothing like that here at all")]
    left = neardup.distinct_documents(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted((r["text"], r["doc_id"]) for r in left.collect()) == sorted([texts[0][::-1], texts[2][::-1], texts[3][::-1]])


def test_near_copies_meet_in_a_crowded_region(spark):
    """600 classes share all of a region's values; copies differ in a place or two and are next to each other in its order."""
    import random

    draw = random.Random(3)
    rows, expected = [], set()
    for i in range(300):
        sketch = [7] * 5 + [draw.randrange(256) for _ in range(115)]
        other = sketch[:60] + [255 - v for v in sketch[60:62]] + sketch[62:]
        names = bytes([0, i // 256, i % 256]), bytes([1, i // 256, i % 256])
        rows += [(names[0], [1], bytes(sketch)), (names[1], [1], bytes(other))]
        expected.add(names)
    table = spark.createDataFrame(rows, "class binary, regions array<long>, sketch binary")
    for region_rows in (10, 10_000):
        pairs = neardup.neighbours(table, 5, region_rows, 0.9).collect()
        assert {(bytes(a), bytes(b)) for a, b in pairs} == expected


def test_components(spark):
    import random

    draw = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)] + [(200 + draw.randrange(30), 200 + draw.randrange(30)) for _ in range(40)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    key = lambda i: i.to_bytes(4, "big")
    table = spark.createDataFrame([(key(a), key(b)) for a, b in links], "a binary, b binary")
    found = {bytes(r["node"]): bytes(r["label"]) for r in neardup.components(table).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {key(x): key(root(x)) for x in linked}


def test_quality(spark, docs, none):
    found = quality.judged(docs, ["doc_id", "text", "kept"]).collect()
    assert len(found) == len(ROWS)
    for r in found:
        n, chars, symbols, again, repeated = quality_numbers(r["row"]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, again, repeated)
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n) and r["row"]["kept"] == "kept"
        assert r["kept"] == (not r["base_failed"])  # too few documents for an estimate
    assert quality.passed(docs).columns == docs.columns
    assert quality.judged(none, ["doc_id"]).count() == 0


def test_repeated_windows(spark):
    texts = ["a b c d e a b c d e", "a b c d e f a b c d e", "x x x x x x", "x x x x x", "a b c d", "p q a b c d e r a b c d e s a b c d e"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(quality.statistics(F.col("text")).alias("s"))
    assert [r["s"]["w"]["n_repeat_words"] for r in got.collect()] == [quality_numbers(t)[4] for t in texts]


def test_outliers_are_found(spark):
    import random

    draw = random.Random(1)
    rows = []
    for i in range(400):
        words = [("#$%" if i % 8 == 0 and k % 3 == 0 else "") + "abcdefghij"[: draw.randrange(2, 9)] + str(draw.randrange(10**6)) for k in range(50)]
        rows.append((i, " ".join(words), "en" if i % 2 else None, "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["row"]["doc_id"]: r["kept"] for r in quality.judged(docs, ["doc_id"]).collect()}
    assert all(kept[i] == (i % 8 != 0) for i in kept)


def test_line_dedup(spark, docs, none):
    more = spark.createDataFrame([(100 + i, f"  Same LINE\t\nown {i}\n\n É") for i in range(10)], "doc_id long, text string")
    done = {r["row"]["doc_id"]: r for r in linededup.dedup(more, keep=["doc_id"]).collect()}
    assert all(r["new_text"] == f"own {i - 100}\n" and r["n_lines"] == 4 and r["n_dropped"] == 2 for i, r in done.items())
    long_only = linededup.dedup(more, min_chars=5, keep=["doc_id"]).first()
    assert long_only["n_dropped"] == 1
    assert linededup.dedup(more.limit(9), keep=["doc_id"]).agg(F.sum("n_dropped")).first()[0] == 0
    cleaned = linededup.cleaned(docs, min_docs=2)
    assert cleaned.columns == docs.columns and cleaned.count() == len(ROWS)
    text = sorted((r["doc_id"] or 0, r["text"] or "") for r in cleaned.collect())
    assert (3, "") in text and (8, ROWS[10][1]) in text
    assert cleaned.where("doc_id = 1 and text is null").count() == 1
    assert linededup.cleaned(none).count() == 0


def test_runs(spark):
    batch = lambda *keys: spark.createDataFrame([([k],) for k in keys], "hashes array<binary>")
    runs = linededup.Runs(spark, fan_in=2)
    for keys in ([b"a", b"b"], [b"a"], [b"c", b"a"]):
        runs.add(batch(*keys))
    assert [len(level) for level in runs.levels] == [1, 1]
    assert sorted(bytes(r["key"]) for r in runs.unseen(batch(b"a", b"z", b"c", b"y")).collect()) == [b"y", b"z"]
    assert [bytes(r["key"]) for r in runs.common(3).collect()] == [b"a"]
    assert linededup.Runs(spark).common(1).count() == 0


def test_language(spark, docs, none):
    found = langid.identify(docs, ["doc_id", "label", "text"]).collect()
    assert len(found) == len(ROWS)
    assert all((r["lang_pred"] == "und") == (not langid.has_letter(r["row"]["text"])) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), ["doc_id"])
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    assert langid.identify(none, ["doc_id"]).count() == 0


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substrings(spark, hot):
    import random

    draw = random.Random(9)
    letters = lambda n: "".join(draw.choice("abcdefé ") for _ in range(n))
    shared, other = letters(500), letters(397)
    texts = [None, "", letters(90), "ab" * 700, shared + letters(60), letters(30) + shared, shared, letters(10) + shared[20:430] + letters(9)]
    texts += [other, other, other + "xyz", other + "xyz", "z" + shared[:450] + letters(40) + shared[60:], LONG[:9000], LONG[:9000], LONG[500:7000]]
    texts += [letters(300) + shared[i : i + 401 + i] + letters(50) for i in range(12)]
    rows = [(None if i == 5 else i, t, "x") for i, t in enumerate(texts)] + [(6, shared, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string").withColumn("nth", F.monotonically_increasing_id())
    length = 400
    for n in (length, 50):
        expected = substring_result({i: (r[1] or "").encode() for i, r in enumerate(rows)}, n)
        found = suffixdedup.dedup(docs, ["doc_id", "hash", "text"], n, hot=hot).collect()
        got = sorted((r["row"]["text"] or "", r["n_bytes"], sum(b - a for a, b in r["removed"]), len(r["removed"]), sha(bytes(r["kept"]))) for r in found)
        assert got == sorted(((rows[i][1] or ""), *x) for i, x in expected.items())


def test_substrings_of_nothing(none):
    assert suffixdedup.dedup(none, ["doc_id"]).count() == 0


def test_html(spark):
    pages = {
        None: "",
        "": "",
        "<p>a&nbsp;&amp; b\n c<br>d<p>e</p>": "a & b c d\n\ne",
        "loose <b>text</b>": "loose text",
        "<nav>menu</nav><main><h1>T</h1><p>one two</p><aside>side</aside><form><p>f</p></form><ul><li>x</li><li>y</li></ul></main>": "T\n\none two\n\nx\n\ny",
        "<body><div class='content'><p>first paragraph of some length here</p><p>ok</p></div><div id=comments><p>a comment that is long, too, really</p></div></body>": "first paragraph of some length here\n\nok",
        "<article><header><h1>Head</h1><p>by me</p></header><p>text</p><div class='ad-box'>buy</div><section class='comments'><p>c</p></section></article>": "Head\n\ntext",
        "<script>var a = '<p>no</p>';</script><style>p{}</style><p>yes": "yes",
    }
    table = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "page_id long, html string").withColumn("text", F.lit("clash"))
    got = {r["row"]["html"]: r["text"] for r in html.extract(table, ["page_id", "html", "text"]).collect()}
    assert got == pages
    long = "<article>" + "<p>paragraph number one</p>" * 20_000 + "</article>"
    assert html.main_text(long).count("paragraph") == 20_000
    assert html.extract(table.where("false"), ["page_id"]).count() == 0


def test_html_wrappers_with_chrome_names():
    said = "a paragraph of the article with some more words in it"
    article = f"<h2 id='discussion'>Discussion</h2><p>{said}</p><h2 class='related' id='related-work'>Work</h2><p id='copyright-law'>{said}</p>"
    expected = f"Discussion\n\n{said}\n\nWork\n\n{said}"
    for wrapper in ("div class='content-sidebar-wrap'", "div class='has-sidebar'", "div class='sidebar'", "div id=menu", "span class=widget", "form id=aspnetForm"):
        for inner in (f"<main><article>{article}</article></main>", f"<div>{article}</div>"):
            page = f"<body><nav>menu</nav><{wrapper}>{inner}<div class='ad wide'>buy this now</div></{wrapper.split()[0]}><div class=comments>c</div></body>"
            assert html.main_text(page) == expected, (wrapper, inner)
    assert html.main_text(f"<main><div class=header><h1>T</h1></div><p>{said} <span class=ad>x</span>end</p></main>") == f"T\n\n{said} end"


def test_html_keeps_every_chosen_line():
    said = "a paragraph of the article with some more words in it"
    for n in (1, 5, 50):
        page = f"<body><nav>menu</nav><div id=content><h1>T</h1><p>lead</p><div class=body>{f'<p>{said}</p>' * n}</div><p>By me</p></div></body>"
        assert html.main_text(page) == "\n\n".join(["T", "lead", *[said] * n, "By me"])
        assert html.main_text(page.replace(" id=content", "").replace("div><p>By me</p></div>", "div>").replace("<div><h1>", "<h1>")) == "\n\n".join(["T", "lead", *[said] * n])
    two = f"<main><article>{f'<p>{said}</p>' * 6}</article><p>ok</p><article>{f'<p>{said}</p>' * 4}</article></main>"
    assert html.main_text(two) == "\n\n".join([said] * 6 + ["ok"] + [said] * 4)
    loose = f"<div>{f'<p>{said}</p>' * 3}</div>" + f"<article>{f'<p>{said}</p>' * 9}</article>"
    assert html.main_text(loose) == "\n\n".join([said] * 12)


LONG = "<p>This is a long paragraph of the article with many words in it, so that its ratio of text to tags is high.</p>"
REPLY = "<p>I, a reader, have an opinion on this article, and I say it at length in this long comment text.</p>"


def page_with(extra, element="article"):
    return f"<html><body><nav><a href=1>Home</a></nav><{element}><h1>Title</h1>{LONG * 3}{extra}</{element}><footer>foot</footer></body></html>"


@pytest.mark.parametrize("element", ["article", "main"])
def test_html_comments_and_boxes_inside_the_article(element):
    plain = html.main_text(page_with("", element))
    assert plain.count("long") == 3
    for name in ("class='comments-area'", "class='comment-body'", "id='user-comments'", "class='commentlist'"):
        assert html.main_text(page_with(f"<div {name}>{REPLY * 4}</div>", element)) == plain, name
    replies = f"<article class='comment-body'>{REPLY}</article><article class=comment>{REPLY}</article>"
    assert html.main_text(page_with(f"<div class=comments>{replies}</div>", element)) == plain
    assert html.main_text(page_with("", element) + f"<section id=comments><article>{REPLY * 3}</article></section>") == plain
    for name in ("cookieConsent", "related-posts", "advert-top", "share-buttons"):
        assert html.main_text(page_with(f"<div class='{name}'><a href=2>Boxed link text here</a> Boxed</div>", element)) == plain, name
    for name, title in (("discussion", "Discussion"), ("related-work", "Related work"), ("search", "Search")):
        text = html.main_text(page_with(f"<div class='{name}'><h2>{title}</h2>{LONG * 2}</div>", element))
        assert text.count("long") == 5 and f"\n\n{title}\n\n" in text


def test_html_deep_nesting_takes_linear_time():
    n = 100_000
    for text in ("<div class=a>" * n + "x", "<div class=a>text " * n, "<span class=b>t " * n, "<div hidden>" + "<b>q" * n, "<article>y " * n):
        start = time.monotonic()
        html.main_text(text)
        assert time.monotonic() - start < 60


def test_components_of_a_block_equal_those_of_all_pairs():
    """The prefix filter loses no link: sets with a common passage, copies with changes, unrelated ones."""
    rng = np.random.default_rng(3)

    def fresh(n):
        return rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def expected(sets, percent):
        label = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
        return label

    for _ in range(40):
        common, sets = fresh(60), []
        for _ in range(int(rng.integers(1, 30))):
            if sets and rng.random() < 0.5:
                old = rng.permutation(sets[rng.integers(len(sets))])
                changed = int(rng.integers(0, len(old) // 8 + 1))
                sets.append(np.unique(np.concatenate((old[changed:], fresh(changed)))))
            else:
                sets.append(np.unique(np.concatenate((common[: rng.integers(0, 60)], fresh(rng.integers(1, 40))))))
        sketch = rng.integers(0, 255, (len(sets), 120)).astype(np.uint8)
        for percent in (50, 80, 85, 100):
            assert neardup.settle(neardup.Sets(sets, sketch), percent).tolist() == expected(sets, percent)
