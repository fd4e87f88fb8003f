"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing extra columns for every operator."""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from lineloom.llm import op1_warc, op2_ngram_join, op3_chat, op4_line_dedup, op5_pii, op6_html, op7_langid, op8_mixing, op9_exact_dedup, op10_decontam

LONG = "lorem ipsum dolor sit amet\n" * 20000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10, "x"), (2, None, "en", "a", None, None), (None, "text without an id", None, None, 3, "y"), (3, "", "fr", "b", 0, ""),
    (4, LONG, "en", "a", len(LONG), "z"), (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10, "x"), (5, "the quick brown fox jumps over the lazy dog again and again", "en", None, 10, "x"),
    (6, " \n\n ", None, "b", 4, "x"), (7, "éà \U0001f600 \x00 #$%", "fr", "b", 4, "x"), (8, "a\nb\nc\na\nb\nc\na\nb\nc", "en", "b", 17, "x"),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r[:5], 1) for r in ROWS]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as h1", "2 as bucket", "'k' as keys", "3 as size", "4 as p", "5 as rank", "6 as item_id", "7 as shingle", "'q' as n_tokens", "8 as pi", "9 as gone")


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id int, m int")


ITEMS = [(1, "the quick brown fox jumps over the lazy dog again", 1, 1), (None, "x", 1, 1), (2, None, 1, 1), (3, "", 1, 1)]
STAGES = [
    ("op2", lambda s, d: op2_ngram_join.similar_documents(d)), ("op2k", lambda s, d: op2_ngram_join.near_duplicates_removed(d)), ("op4", lambda s, d: op4_line_dedup.lines_deduplicated(d)), ("op5", lambda s, d: op5_pii.entities(d)),
    ("op7", lambda s, d: op7_langid.identify(d, op7_langid.training_texts(d))), ("op7k", lambda s, d: op7_langid.identified(d, op7_langid.training_texts(d))), ("op8", lambda s, d: op8_mixing.sample(d)), ("op8k", lambda s, d: op8_mixing.mixed(d)),
    ("op9", lambda s, d: op9_exact_dedup.exact_duplicates(d)), ("op9k", lambda s, d: op9_exact_dedup.exact_duplicates_removed(d)), ("op10", lambda s, d: op10_decontam.contaminated(d, bench(s, ITEMS))),
    ("op10s", lambda s, d: op10_decontam.contaminated(d, bench(s, ITEMS), item_bytes=0)), ("op10k", lambda s, d: op10_decontam.contaminated_removed(d, bench(s, ITEMS))), ("op10none", lambda s, d: op10_decontam.contaminated(d, bench(s, []))),
]
IDS = ["1", "1", "2", "3", "4", "5", "6", "7", "8", "None"]


@pytest.mark.parametrize("name,f", STAGES, ids=[n for n, _ in STAGES])
def test_messy_and_empty(spark, docs, name, f):
    got = f(spark, docs)
    rows = got.collect()
    empty = f(spark, docs.limit(0))
    assert empty.collect() == []
    assert empty.columns == got.columns
    if name.endswith("k"):
        assert got.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in rows) if "doc_id" in got.columns else None
    without = lambda *gone: [i for i in IDS if i not in gone]
    if name == "op2":
        assert sorted(map(tuple, rows)) == [(1, 1, 1), (5, 1, 1)]
    if name == "op2k":
        assert ids == without("5")
    if name == "op4":
        text = {r["doc_id"]: (r["text"], r["n_removed"]) for r in rows}
        assert len(rows) == len(ROWS) and text[8] == ("a\nb\nc", 6) and text[4][1] == 19997 and text[2] == (None, 0) and text[3] == ("", 0)
    if name == "op5":
        assert rows == []
    if name == "op7":
        found = {r["doc_id"]: (r["lang_found"], r["rejected"]) for r in rows}
        assert len(rows) == len(ROWS) and found[1] == found[5] == ("en", False) and found[4][0] and all(found[k] == (None, True) for k in (2, 3, 6)) and found[7][0] == "fr"
    if name == "op7k":
        assert set(ids) >= {"1", "4", "5"} and not set(ids) & {"2", "3", "6"} and ids.count("1") == 2
    if name == "op8":
        assert "None" not in ids and len(ids) == len(set(ids)) and set(ids) >= {"3", "5", "6", "7", "8"}  # the small sources are taken whole
    if name == "op8k":
        assert "None" not in ids and ids.count("1") in (0, 2) and set(ids) >= {"3", "5", "6", "7", "8"}
    if name == "op9":
        assert sorted(map(tuple, rows)) == [(5, 1, len(ROWS[0][1]))]
    if name == "op9k":
        assert ids == without("5")
    if name in ("op10", "op10s"):
        assert ids == ["1", "5"] and {(r["item_id"], r["matched"], r["n_shingles"], r["containment"]) for r in rows} == {(1, 6, 6, 1.0)}
    if name == "op10k":
        assert ids == without("1", "5")
    if name == "op10none":
        assert rows == []


def test_ties(spark):
    """Of equal things the least doc_id, the first item or the first position wins, whatever the order of the rows."""
    text = "one two three four five six seven eight nine ten"
    rows = [(k, text if k % 2 else text.upper(), "en", "s", 1) for k in (9, 4, 7, 2, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert {tuple(r) for r in op2_ngram_join.similar_documents(df).collect()} == {(k, 2, 4) for k in (2, 4, 5, 7, 9)}
    assert {tuple(r)[:2] for r in op9_exact_dedup.exact_duplicates(df).collect()} == {(4, 2), (7, 5), (9, 5)}
    found = op10_decontam.contaminated(df, bench(spark, [(2, text, 1, 1), (1, text, 1, 1)])).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(k, i) for k in (2, 4, 5, 7, 9) for i in (1, 2)]
    kept = [sorted(r["doc_id"] for r in op8_mixing.sample(df.repartition(n), keep=0.6).collect()) for n in (1, 3)]
    assert kept[0] == kept[1] and len(kept[0]) == 3


def folder(spark, path, rows, items) -> str:
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int").write.parquet(f"{path}/documents.parquet")
    bench(spark, items).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(*r[:5], 1) for r in ROWS]
    got = cp.run(spark, folder(spark, tmp_path / "messy", rows, [(9, "never seen words of some other text", 1, 1)]))
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n"]
    assert set(ids) <= {1, 4, 7, 8} and ids.count(1) in (0, 2)  # no null id or text, no empty text, no copy
    assert cp.run(spark, folder(spark, tmp_path / "empty", [], [])).collect() == []
    unlabelled = [(k, "some plain text of a few words", None, "s", 1, 1) for k in range(3)]
    assert cp.run(spark, folder(spark, tmp_path / "nolang", unlabelled, [])).collect() == []
    one = [(1, "a plain text with quite enough words in it", "en", None, 1, 1), (2, "a plain text with quite enough words in it", "en", "s", 1, 1)]
    assert [r["doc_id"] for r in cp.run(spark, folder(spark, tmp_path / "copies", one, [])).collect()] in ([1], [])


def shingles(text: str, n: int) -> list[tuple]:
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())
    return [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def brute_classes(rows: list[tuple[int, str]]) -> dict[int, int]:
    """Class of every document that has a similar one, by comparing all pairs."""
    sets, root = {i: g for i, t in rows if (g := set(shingles(t, 3)))}, {}

    def top(i: int) -> int:
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, g in sets.items():
        for x in g:
            by[x].append(i)
    for a, b in {p for ids in by.values() for p in itertools.combinations(sorted(ids), 2)}:
        both = len(sets[a] & sets[b])
        if 2 * both >= len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in root}


def holds(text: str, item: str) -> bool:
    """Whether some window of the item's length has 0.8 of its distinct shingles."""
    own, doc = shingles(item, 5), shingles(text, 5)
    need = math.ceil(round(0.8 * len(set(own)), 9))
    return bool(own) and any(len(set(doc[p : p + len(own)]) & set(own)) >= need for p in range(len(doc)))


def brute_pipeline(spark, sf: str) -> set[int]:
    """What the first four stages keep, in plain Python but for the language model's trained tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = op7_langid.Model(op7_langid.training_texts(docs))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    ok = model.classify(pa.array([t for _, t in rows], pa.string()))[2]
    rows = sorted(r for r, keep in zip(rows, ok, strict=True) if keep)
    first: dict[str, int] = {}
    for i, t in rows:
        first.setdefault(t, i)
    rows = [(i, t) for i, t in rows if first[t] == i]
    gone = {i for i, c in brute_classes(rows).items() if i != c}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    return {i for i, t in rows if i not in gone and not any(holds(t, x) for x in items)}


def test_pipeline_against_brute_force(spark):
    """run() keeps a balanced part of what plain Python keeps, and all of the sources that the weights take whole."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = d = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "mix"]
    for _, stage in cp.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == docs.columns
    want = brute_pipeline(spark, sf)
    assert {r["doc_id"] for r in d.select("doc_id").collect()} == want
    kept = [r["doc_id"] for r in cp.run(spark, sf).select("doc_id").collect()]
    sample = {r["doc_id"]: r for r in op8_mixing.sample(docs.where(docs["doc_id"].isin(*want))).collect()}
    assert len(kept) == len(set(kept)) and set(kept) == set(sample)
    tokens = {r["doc_id"]: r["n_tokens"] for r in op8_mixing.units(docs.where(docs["doc_id"].isin(*want))).collect()}
    assert abs(sum(tokens[k] for k in kept) - 0.8 * sum(tokens.values())) <= 2 * max(tokens.values())


def test_warc_edges(spark):
    rows = [(1, "http://a", "<p>é</p>"), (None, None, None), (2, "http://b\r\nX: y", ""), (1, "http://a", "<p>é</p>")]
    from lineloom.llm import shared

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as path", "1 as payload")
    got = op1_warc.read_warc(op1_warc.write_warc(pages, shared.fresh_path(spark, "t"))).collect()
    assert sorted((r["page_id"] or 0, bytes(r["payload"]).decode(), r["digest_ok"]) for r in got) == [(0, "", True), (1, "<p>é</p>", True), (1, "<p>é</p>", True), (2, "", True)]
    none = op1_warc.read_warc(op1_warc.write_warc(pages.limit(0), shared.fresh_path(spark, "t")))
    assert none.collect() == []


def test_chat_edges(spark):
    rows = [(1, 0, "user", '[{"type":"text","text":"hi"},{"type":"image_url","image_url":{"url":"u.png"}}]'), (1, None, None, None), (None, 1, "a", "[1]"), (1, 0, "user", ""), (2, 0, "user", "<|end|> ![x](a.mp3)")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as rendered", "2 as t")
    got = {r["conv_id"]: r for r in op3_chat.chats(df).collect()}
    assert got[1]["n_turns"] == 3 and [(a["kind"], a["ref"], a["n_tokens"]) for a in got[1]["attachments"]] == [("image", "u.png", 256)]
    assert "<|image|>" in got[1]["text"] and got[1]["text"].startswith("<|unknown|>")
    assert got[2]["text"] == "<|user|>\n< |end|> <|audio|><|end|>\n" and got[None]["n_turns"] == 1
    assert op3_chat.chats(df.limit(0)).collect() == []


def test_html_edges(spark):
    page = "<html><body><nav><a href=x>home</a></nav><article><p>" + "many words of running text that nobody links to " * 8 + "</p></article></body></html>"
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "<p" * 1000), (1, "u", page), (4, "u", page * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as n_blocks")
    got = op6_html.main_texts(df).collect()
    assert len(got) == 6
    assert all("running text" in r["text"] and "home" not in r["text"] for r in got if r["page_id"] == 1)
    assert op6_html.main_texts(df.limit(0)).collect() == []
