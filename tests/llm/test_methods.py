"""The corpus operators' methods against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import gzip
import io
import itertools
import json
import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lineloom.llm import op1_warc, op2_ngram_join, op3_chat, op4_line_dedup, op5_pii, op6_html, op7_langid, op8_mixing, op9_exact_dedup, op10_decontam, shared, textkernel

SF = "/root/testdata/sf0.001"
WORD = re.compile("[a-z0-9\\x80-\\U0010ffff]+")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pydict()


@pytest.fixture
def no_broadcast(monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)


def norm(v) -> str:
    return f"{v:.6g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else repr(v)


def same_as_sql(rows, cursor) -> bool:
    names = [c[0] for c in cursor.description]
    cols = sorted(names)
    want = sorted("|".join(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cursor.fetchall())
    return want == sorted("|".join(norm(r[c]) for c in cols) for r in rows) and bool(want)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("op", [op1_warc, op2_ngram_join, op4_line_dedup, op9_exact_dedup, op10_decontam], ids=lambda m: m.__name__.rpartition(".")[2])
def test_query_against_sql(spark, duck, op):
    query = getattr(op, op.__name__.rpartition(".")[2])
    assert same_as_sql(query(spark, SF).collect(), duck.execute(op.ORACLE))


@pytest.mark.parametrize("op", [op2_ngram_join, op4_line_dedup, op9_exact_dedup, op10_decontam], ids=lambda m: m.__name__.rpartition(".")[2])
def test_query_without_broadcast(spark, duck, no_broadcast, op):
    query = getattr(op, op.__name__.rpartition(".")[2])
    assert same_as_sql(query(spark, SF).collect(), duck.execute(op.ORACLE))


def test_kept_and_dropped_ids_without_broadcast(spark, no_broadcast):
    df, ids = spark.range(10).withColumnRenamed("id", "doc_id"), shared.cut(spark.range(3).withColumnRenamed("id", "doc_id"))
    assert sorted(r[0] for r in shared.keep_ids(df, ids, "doc_id").collect()) == [0, 1, 2]
    assert sorted(r[0] for r in shared.drop_ids(df, ids, "doc_id").collect()) == list(range(3, 10))


def test_words_of_long_texts_in_pieces():
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab é,.9 ", k=rng.randint(0, 400))) for _ in range(30)] + ["x" * 500, "", "é" * 300]
    data, off = textkernel.utf8(pa.array(texts))
    want = [textkernel.words(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))[0].tolist() for i in range(len(texts))]
    for size in (16, 64, 1 << 20):
        got = []
        for i, j, word, at in textkernel.word_rows(data, off, size):
            got += [word[at[k] : at[k + 1]].tolist() for k in range(j - i)]
        assert got == want


def test_divide_skip_against_counting():
    rng = random.Random(1)
    for trial in range(200):
        top = 8 if trial % 2 else 200
        lists = [np.array(sorted(rng.sample(range(top), rng.randint(0, top)))) for _ in range(rng.randint(1, 12))]
        need = rng.randint(1, 8)
        count = defaultdict(int)
        for x in lists:
            for i in x.tolist():
                count[i] += 1
        ids, n = op2_ngram_join.divide_skip(lists, need)
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == {k: v for k, v in count.items() if v >= need}
        assert op2_ngram_join.merge_lists([x.tolist() for x in lists], need) == {k: v for k, v in count.items() if v >= need}


def grams(text: str) -> set:
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_classes(rows: list[tuple[int, str]], threshold: float = 0.5) -> set[tuple[int, int, int]]:
    sets = {i: g for i, t in rows if (g := grams(t))}
    links = defaultdict(set)
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            links[a].add(b)
            links[b].add(a)
    out = set()
    for a in links:
        seen, todo = {a}, [a]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        out.add((a, min(seen), len(links[a])))
    return out


@pytest.mark.parametrize("block,block_grams", [(2048, 400_000), (16, 3000)])
def test_hot_bucket_gives_every_link(spark, monkeypatch, block, block_grams):
    """Texts around one passage that all share, so that similarities lie on both sides of the threshold."""
    monkeypatch.setattr(op2_ngram_join, "BLOCK", block)
    monkeypatch.setattr(op2_ngram_join, "BLOCK_GRAMS", block_grams)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(260):
        own = [word() for _ in range(rng.choice((5, 20, 28, 32, 60, 150)))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, " ".join(own[:at] + passage + own[at:])))
    rows += [(1000 + i, rows[i][1].upper()) for i in range(0, 40, 2)]  # copies by words
    got = {tuple(r) for r in op2_ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert got == want and sum(n for _, _, n in want) > 2000


def test_packed_round_trip():
    x = np.array([0, 1, (1 << 48) - 1], np.uint64)
    assert (op2_ngram_join.unpacked(op2_ngram_join.packed(x)) == x).all()


def test_warc_reader_on_damage():
    a, b = op1_warc.record(1, "u", "first"), op1_warc.record(2, "v", "second")
    rows = list(op1_warc.WarcReader(io.BytesIO(a[:40] + b"\0\0\0" + b), 16))
    assert rows[0]["error"] and rows[-1]["payload"] == b"second" and rows[-1]["digest_ok"]
    cut = list(op1_warc.WarcReader(io.BytesIO(a + b[:-20]), 7))
    assert cut[0]["payload"] == b"first" and "error" in cut[1]
    forged = gzip.compress(gzip.decompress(a).replace(b"first", b"thirs"))
    assert list(op1_warc.WarcReader(io.BytesIO(forged)))[0]["digest_ok"] is False


def test_warc_reader_goes_on_after_a_bad_record():
    one, two = gzip.decompress(op1_warc.record(1, "u", "one")), gzip.decompress(op1_warc.record(2, "v", "two"))
    bad = b"WARC/1.1\r\nContent-Length: many\r\n\r\nlost\r\n\r\n"
    for raw in (one + bad + two, gzip.compress(one + b"garbage\r\n\r\n" + two), one + b"A" * (2 << 20) + b"\n" + two):
        for piece in (7, 1 << 16):
            rows = list(op1_warc.WarcReader(io.BytesIO(raw), piece))
            assert [r.get("payload") for r in rows] == [b"one", None, b"two"] and "ValueError" in rows[1]["error"]


def test_chat_against_brute_force(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op3_chat.TOKENIZER)
    tok.encode_special_tokens = True
    size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    kinds = {"image": (r"png|jpe?g|gif|webp", 256), "audio": (r"wav|mp3|flac|ogg", 0), "document": (r"pdf|docx|txt", 560)}
    table, want = pq.read_table(f"{SF}/conversations.parquet").to_pylist(), {}
    by = defaultdict(list)
    for r in table:
        by[r["conv_id"]].append(r)
    for conv, turns in by.items():
        text, tokens, refs = "", 0, []
        for r in sorted(turns, key=lambda r: (r["turn"], r["role"], r["text"])):
            rendered, content = "", r["text"] or ""
            parts = None
            if content.lstrip().startswith("["):
                try:
                    parts = json.loads(content)
                except ValueError:
                    parts = None
            if isinstance(parts, list) and parts and all(isinstance(x, dict) and "type" in x for x in parts):
                pytest.skip("the fixture has typed parts: extend the brute force")
            at = 0
            for m in re.finditer(r"!\[[^\]\n]*\]\(([^()\s]+)\)", content):
                kind = next((k for k, (e, _) in kinds.items() if re.search(rf"\.(?:{e})(?:[?#]|$)", m[1], re.I)), None)
                if kind:
                    plain = content[at : m.start()].replace("<|", "< |")
                    rendered, tokens, at = rendered + plain + f"<|{kind}|>", tokens + (size(plain) if plain else 0), m.end()
                    refs.append((kind, m[1], kinds[kind][1]))
            plain = content[at:].replace("<|", "< |")
            text += f"<|{(r['role'] or 'unknown').replace('<|', '< |')}|>\n{rendered}{plain}<|end|>\n"
            tokens += size(plain) if plain else 0
        want[conv] = (len(turns), text, tokens, sum(r[2] for r in refs), refs)
    got = {r["conv_id"]: (r["n_turns"], r["text"], r["n_text_tokens"], r["n_attachment_tokens"], [tuple(a) for a in r["attachments"]]) for r in op3_chat.op3_chat(spark, SF).collect()}
    assert got == want and len(want) > 10


# Personal data


@pytest.fixture(scope="module")
def model():
    return op5_pii.train()


def test_held_out_entities(model):
    """On examples of another seed; without the skip potentials the result is worse."""
    weight, pair = model
    graph, gold = op5_pii.labelled(op5_pii.examples(300, 77))
    features, edges = graph.arrays()
    gold = gold[: graph.nodes]
    score = {}
    for name, p in (("skip", pair), ("chain", np.stack([pair[0], 0 * pair[1], 0 * pair[2]]))):
        label = op5_pii.beliefs(op5_pii._unary(features, graph.nodes + graph.hubs, weight), edges, p)[0].argmax(1)[: graph.nodes]
        score[name] = (label == gold).mean()
        if name == "skip":
            assert (label == gold)[label > 0].mean() > 0.95 and (label == gold)[gold > 0].mean() > 0.95
    assert score["skip"] > score["chain"] + 0.002


def test_skip_edges_change_labels(model):
    weight, pair = model
    chain = np.stack([pair[0], 0 * pair[1], 0 * pair[2]])
    text = pa.array(["call 2125550147 now. " + "then 2125550147 again. " * 50, "the count of 2125550147 was seen"])
    found = [Counter(r for r, *_ in op5_pii.tag(text, weight, p)) for p in (pair, chain)]
    assert found == [Counter({0: 51}), Counter({0: 1})]


def exact_labels(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Marginals by enumeration of every labelling."""
    n, k = unary.shape
    out = np.zeros((n, k))
    for label in itertools.product(range(k), repeat=n):
        p = math.exp(sum(unary[i, x] for i, x in enumerate(label)) + sum(pair[t, label[a], label[b]] for a, b, t in edges.tolist()))
        out[np.arange(n), label] += p
    return out / out.sum(1, keepdims=True)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    tree = np.array([(0, 3, 1), (1, 3, 1), (2, 3, 2), (2, 4, 0)])  # a hub and a chain: exact
    loop = np.array([(0, 1, 0), (1, 2, 0), (0, 3, 1), (2, 3, 1)])
    for edges, tolerance in ((tree, 1e-3), (loop, 0.08)):
        for _ in range(5):
            unary, pair = rng.normal(size=(5, 3)), rng.normal(size=(3, 3, 3)) * 0.7
            assert np.abs(op5_pii.beliefs(unary, edges, pair)[0] - exact_labels(unary, edges, pair)).max() < tolerance


def test_entities_of_small_documents_against_enumeration(model, docs):
    """Labels of the table's documents with few nodes, found by trying every labelling."""
    weight, pair = model
    checked = 0
    for text in docs["text"]:
        tokens = re.findall(r"[^\t\n\x0b\x0c\r ]+", text or "")
        graph = op5_pii.Graph()
        graph.add(op5_pii.chosen(tokens))
        if not 0 < graph.nodes + graph.hubs <= 5:
            continue
        features, edges = graph.arrays()
        unary = op5_pii._unary(features, graph.nodes + graph.hubs, weight)
        want = exact_labels(unary, edges, pair)[: graph.nodes]
        got = op5_pii.beliefs(unary, edges, pair)[0][: graph.nodes]
        assert (want.argmax(1) == got.argmax(1)).all()
        found = Counter(x[1] for x in op5_pii.tag(pa.array([text]), weight, pair))
        labels = Counter(op5_pii.LABELS[k] for k in want.argmax(1) if k)
        assert {k: v for k, v in found.items() if k not in ("phone", "card")} == {k: v for k, v in labels.items() if k not in ("phone", "card")}
        assert set(found) == set(labels)
        checked += 1
    assert checked > 10


def test_entities_planted(spark):
    text = "Write to anna.berg@mail.example.org or call +1 212 555 0147 today. The server 10.20.30.40 is down. Nothing private in 1999 or chapter 12."
    more = "password = correcthorsebatterystaple, so correcthorsebatterystaple it is; pay with 4111 1111 1111 1111 now"
    clean = "In 1845 there were 12 ships and 300 men; page 7 of 19 says so. The password is needed."
    df = spark.createDataFrame([(1, text), (2, clean), (3, more), (3, more)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["label"], r["value"]) for r in op5_pii.entities(df).collect())
    assert {(1, "email", "anna.berg@mail.example.org"), (1, "ip", "10.20.30.40"), (1, "phone", "+1 212 555 0147"), (3, "card", "4111 1111 1111 1111")} <= set(got)
    assert got[(3, "secret", "correcthorsebatterystaple")] == 4 and not any(k[0] == 2 and k[1] != "secret" for k in got)


def test_cue_reaches_fifty_mentions():
    for stay in (2.0, 6.0):
        unary, pair = np.zeros((50, 3)), np.zeros((3, 3, 3))
        unary[0, 1], unary[:, 0], pair[1] = 30, 0.001, stay * np.eye(3)
        node, both = op5_pii.beliefs(unary, np.array([(i, i + 1, 1) for i in range(49)]), pair)
        right = [np.ones(3)]
        left = [np.ones(3)]
        for i in range(49):  # the exact marginals of a chain
            right.append(np.exp(pair[1]).T @ (right[-1] * np.exp(unary[i])))
            left.append(np.exp(pair[1]) @ (left[-1] * np.exp(unary[49 - i])))
            right[-1], left[-1] = right[-1] / right[-1].sum(), left[-1] / left[-1].sum()
        exact = np.array([right[i] * np.exp(unary[i]) * left[49 - i] for i in range(50)])
        exact /= exact.sum(1, keepdims=True)
        assert np.abs(node - exact).max() < 0.01 and np.abs(both.sum(2) - node[:-1]).max() < 0.01
    assert node.argmax(1).tolist() == [1] * 50


# HTML


class Blocks(HTMLParser):
    """Text blocks by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.words, self.linked, self.link, self.silent = [], [], 0, 0, ""

    def close_block(self):
        if self.words:
            self.out.append((" ".join(self.words), len(self.words), self.linked))
        self.words, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if self.silent:
            return
        if tag in op6_html.SILENT:
            self.silent = tag
            self.close_block()
        elif tag == "a":
            self.link = 1
        elif tag not in op6_html.INLINE:
            self.close_block()

    def handle_endtag(self, tag):
        if self.silent:
            self.silent = "" if tag == self.silent else self.silent
        elif tag == "a":
            self.link = 0
        elif tag not in op6_html.INLINE:
            self.close_block()

    def handle_data(self, data):
        if not self.silent:
            got = data.split()
            self.words += got
            self.linked += len(got) * self.link


def leaf(tree, x) -> float:
    while tree.feature >= 0:
        tree = tree.low if x[tree.feature] <= tree.cut else tree.high
    return tree.value


def test_main_texts_against_another_parser(spark):
    want, agree = {}, 0
    for r in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        p = Blocks()
        p.feed(r["html"] or "")
        p.close()
        p.close_block()
        rows = [(0, 0), *((w, 100.0 * k / w) for _, w, k in p.out), (0, 0)]
        keep = [b[0] for i, b in enumerate(p.out) if leaf(op6_html.tree(), [*rows[i], *rows[i + 1], *rows[i + 2]]) >= 0.5]
        want[r["page_id"]] = ("\n".join(keep), len(p.out), len(keep))
    for r in op6_html.op6_html(spark, SF).collect():
        agree += want[r["page_id"]] == (r["text"], r["n_blocks"], r["n_content"])
    assert agree >= 0.98 * len(want) and len(want) >= 20  # pages cut off within a tag are read differently


def test_tags_with_quotes_and_link_cards():
    assert op6_html.blocks('<p title="a > b c d">hello') == [("hello", 1, 0)]
    assert op6_html.blocks("<a><div>one two three four</div></a> x") == [("one two three four", 4, 4), ("x", 1, 0)]
    assert op6_html.blocks("<a href=x>never closed<p>text here</p>") == [("never closed", 2, 2), ("text here", 2, 0)]
    assert op6_html.blocks('<p title="open>hello') == [("hello", 1, 0)]


def test_main_texts_of_other_templates():
    """Pages of templates that the table knows nothing of."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("river stone winter quiet market letter table window garden north".split()) for _ in range(n))
    right = total = 0
    for k in range(60):
        menu = "".join(f"<li><a href='/{i}'>{say(rng.randint(1, 3))}</a></li>" for i in range(rng.randint(5, 12)))
        cards = "".join(f"<div class=card><a href='/c{i}'><h3>{say(5)}</h3><span>{say(3)}</span></a></div>" for i in range(rng.randint(3, 6)))
        body = [say(rng.randint(35, 120)) for _ in range(rng.randint(3, 8))]
        foot = f"<footer><a href=/a>{say(2)}</a> | <a href=/b>{say(2)}</a></footer>"
        page = f"<html><body><ul>{menu}</ul>" + (f"<section>{cards}</section>" if k % 2 else "") + "<main>" + "".join(f"<p>{x}</p>" for x in body) + f"</main>{foot}</body></html>"
        found = op6_html.blocks(page)
        content = op6_html.tree().predict(op6_html.features(found)) >= 0.5
        truth = np.array([b[0] in body for b in found])
        right, total = right + int((content == truth).sum()), total + len(truth)
    assert right > 0.9 * total


# Language


def test_cross_parsing_held_out(docs):
    texts, rest = defaultdict(str), []
    for t, lang in zip(docs["text"], docs["lang"], strict=True):
        if t and lang and len(texts[lang]) < 15000 and len(t) < 5000:
            texts[lang] += t + "\n"
        elif t and lang and len(t) > 200:
            rest.append((t, lang))
    names, _, ok = op7_langid.Model(dict(texts)).classify(pa.array([t for t, _ in rest]))
    right = [n == lang for n, (_, lang) in zip(names.to_pylist(), rest, strict=True)]
    assert len(rest) > 40 and np.mean(right) > 0.95 and np.mean(ok) > 0.95


def brute_phrases(s: list[int], train: list[int]) -> int:
    text, n, at = f" {' '.join(map(str, train))} ", 0, 0
    while at < len(s):
        size = 1
        while at + size < len(s) and f" {' '.join(map(str, s[at : at + size + 1]))} " in text:
            size += 1
        at, n = at + size, n + 1
    return n


def test_winning_language_against_brute_force(docs):
    """Language and bits of whole texts, each parsed from front to back by plain search."""
    texts = defaultdict(str)
    for t, lang in zip(docs["text"], docs["lang"], strict=True):
        if t and lang and len(texts[lang]) < 1500:
            texts[lang] += t[: 1500 - len(texts[lang])]
    model = op7_langid.Model(dict(texts), window=64)
    some = [t for t in docs["text"] if t and 10 < len(t) < 600][:25]
    names, bits, _ = model.classify(pa.array(some))
    coded = lambda t: op7_langid.encode(np.frombuffer(t.lower().encode(), np.uint8), np.array([0, len(t.lower().encode())]), model.code)[0].tolist()
    train = {lang: coded(texts[lang]) for lang in sorted(texts)}
    for t, name, b in zip(some, names.to_pylist(), bits, strict=True):
        s = coded(t)
        rate = {lang: brute_phrases(s, x) * math.log2(len(x)) / len(s) for lang, x in train.items()} if s else {}
        assert (name, round(float(b), 9)) == ((best := min(rate, key=lambda k: (rate[k], k))), round(rate[best], 9))
    assert len(some) == 25


def test_phrases_go_on_across_pieces():
    rng = random.Random(2)
    for _ in range(40):
        train = "".join(rng.choices("abc ", k=rng.randint(3, 60))).strip() or "a"
        model = op7_langid.Model({"x": train}, window=rng.choice((1, 2, 3, 7, 16)))
        rows = ["".join(rng.choices("abcd ", k=rng.randint(0, 80))) for _ in range(12)]
        off = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        symbols, at = op7_langid.encode(np.frombuffer("".join(rows).encode(), np.uint8), off, model.code)
        known = op7_langid.encode(np.frombuffer(train.encode(), np.uint8), np.array([0, len(train)]), model.code)[0].tolist()
        got = model.phrases(symbols, at)[0].tolist()
        assert got == [brute_phrases(symbols[at[k] : at[k + 1]].tolist(), known) for k in range(len(rows))]


def test_long_texts_encoded_in_pieces(docs):
    code = op7_langid.letters({"x": "".join(t or "" for t in docs["text"][:50])})
    raw = np.frombuffer(("".join(t or "" for t in docs["text"][:100]) + "é" * 2000 + "  \n  " * 400).lower().encode(), np.uint8)
    whole = op7_langid.encode(raw, np.array([0, len(raw)]), code)[0]
    for piece in (100, 1000):
        assert (op7_langid.encoded(raw, np.array([0, len(raw)]), code, piece)[0] == whole).all()


def test_short_clean_documents_stay(docs):
    texts: dict[str, str] = {}
    for t, lang in zip(docs["text"], docs["lang"], strict=True):
        if lang and len(texts.get(lang, "")) < 30_000:
            texts[lang] = texts.get(lang, "") + t[:10_000] + "\n"
    model = op7_langid.Model(texts)
    word = next(w for w in texts["en"].split() if w.isalpha() and len(w) > 5)
    short = ["A.", "Re.", "De.", f"{word} sh.", f'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" {word} {word}.']
    assert model.classify(pa.array(short))[2].all()
    rng = random.Random(4)
    junk = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(50)] + ["9f3a 77be1 0c4"]
    assert not model.classify(pa.array(junk))[2].any()


def test_every_letter_is_a_symbol():
    rng = random.Random(6)
    alphabets = {"zh": range(0x4E00, 0x5200), "ko": range(0xAC00, 0xAF00), "ext": range(0x20000, 0x20200), "el": range(0x3B1, 0x3C8)}
    vocabulary = {lang: ["".join(map(chr, rng.choices(a, k=rng.randint(1, 3)))) for _ in range(150)] for lang, a in alphabets.items()}
    text = {lang: lambda n, v=v: "".join(rng.choices(v, k=n)) for lang, v in vocabulary.items()}
    train = {lang: f(1500) for lang, f in text.items()}
    held = [(lang, f(60)) for lang, f in text.items() for _ in range(5)]
    columns = pa.array([t for _, t in held])
    dense, sparse = op7_langid.Model(train, dense=1 << 40), op7_langid.Model(train, dense=0)
    names, bits, ok = dense.classify(columns)
    assert names.to_pylist() == [lang for lang, _ in held] and ok.all()
    again = sparse.classify(columns)
    assert again[0].equals(names) and (again[1] == bits).all() and (again[2] == ok).all()
    for lang in ("zh", "ko"):  # other letters of the same kind are not the language
        other = pa.array(["".join(chr(alphabets[lang].stop + rng.randrange(500)) for _ in range(200))])
        assert not dense.classify(other)[2].any()


def test_language_of_long_documents_is_trained(spark):
    rows = [(i, "lorem ipsum dolor " * 4000, "la") for i in range(80)] + [(200 + i, "short text here", "en") for i in range(3)] + [(300 + i, "x y " * 20000, "en") for i in range(80)]
    texts = op7_langid.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert texts["la"].startswith("lorem ipsum") and len(texts["la"]) <= op7_langid.TRAIN_CHARS
    assert texts["en"] == "short text here\n" * 3


def test_ties_go_to_the_first_language():
    model = op7_langid.Model({"b": "same text here", "a": "same text here"})
    assert model.classify(pa.array(["text here", "same"]))[0].to_pylist() == ["a", "a"]


# Mixing


def brute_pi(tokens: dict, weights: dict, keep: float) -> dict:
    """Inclusion probabilities by bisection."""
    lo, hi = 0.0, sum(tokens.values()) / min(w for w in weights.values() if w) + 1
    for _ in range(200):
        c = (lo + hi) / 2
        if sum(min(t, c * weights.get(s, 0)) for s, t in tokens.items()) < keep * sum(tokens.values()):
            lo = c
        else:
            hi = c
    return {s: min(1.0, lo * weights.get(s, 0) / t) for s, t in tokens.items() if t and weights.get(s, 0)}


_WEIGHTS = {"s0": 1.0, "s1": 2.0, "s2": 5.0, "s9": 1.0}


@pytest.mark.parametrize("weights,keep,group,small", [(None, 0.8, 5000, True), (None, 0.8, 40, False), (_WEIGHTS, 0.3, 60, True), (None, 1.0, 5000, True)])
def test_sample_is_balanced(spark, monkeypatch, weights, keep, group, small):
    """A hot source, many small ones; totals are kept to within the landing's last documents."""
    if not small:
        monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 50), f"s{min(9, int(rng.expovariate(1)))}") for i in range(2500)] + [(9000, None, None), (9001, " \n x\ty ", None), (None, "a", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    unit = {(r[0], r[1]): r[2] for r in op8_mixing.units(df).collect()}
    assert unit == {(i, s): len((t or "").split()) for i, t, s in rows if i is not None}
    tokens = defaultdict(int)
    for (_, s), n in unit.items():
        tokens[s] += n
    pi = brute_pi(tokens, weights or dict.fromkeys(tokens, 1.0), keep)
    kept = op8_mixing.sample(df, weights, keep, group=group).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in op8_mixing.sample(df, weights, keep, group=group).collect())
    assert all(abs(r["pi"] - pi[r["source"]]) < 1e-6 for r in kept) and len({(r["doc_id"], r["source"]) for r in kept}) == len(kept)
    want_tokens, want_docs = sum(pi.get(s, 0) * n for (_, s), n in unit.items()), sum(pi.get(s, 0) for _, s in unit)
    assert abs(sum(r["n_tokens"] for r in kept) - want_tokens) <= 2 * 50 and abs(len(kept) - want_docs) < 1.001
    for s, p in pi.items():
        assert abs(sum(r["n_tokens"] for r in kept if r["source"] == s) - p * tokens[s]) <= 4 * 50


def test_token_counts_of_long_texts(spark):
    rows = [(1, "ab cd " * 400_000 + "é"), (2, "x" * 3_000_000), (3, " x" * 700_001)]
    got = {r["doc_id"]: r["n_tokens"] for r in op8_mixing.units(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source")).collect()}
    assert got == {i: len(t.split()) for i, t in rows}


# Exact copies, benchmark


def test_chunks_that_share_a_hash_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, op9_exact_dedup.exact_duplicates(docs).collect()))
    for bits in (1, 6):
        assert sorted(map(tuple, op9_exact_dedup.exact_duplicates(docs, bits).collect())) == want
    assert want


def test_long_texts_are_cut_the_same_in_pieces():
    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.choices(range(97, 110), k=300_000)) + b"a" * 100_000, np.uint8)
    end, _, hashed, _ = op9_exact_dedup.chunk_ends(data, np.array([0, len(data)]))
    for piece in (20_000, 131_072):
        (_, _, ends, lengths, hashes, _) = next(op9_exact_dedup.cut_rows(data, np.array([0, len(data)]), piece))
        assert (ends == end).all() and (hashes == hashed).all() and lengths.sum() == len(data)


def test_decontamination_by_shuffle_agrees_with_sql(spark, duck):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert same_as_sql(op10_decontam.contaminated(docs, items, item_bytes=0).collect(), duck.execute(op10_decontam.ORACLE))


def test_memory_of_workers_is_level(spark):
    """What a Python worker holds doesn't climb over ten runs of the operators that the pipeline has."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    texts = op7_langid.training_texts(docs)

    def resident(batches):
        for _ in batches:
            pass
        pages = int(open("/proc/self/statm").read().split()[1])
        yield pa.RecordBatch.from_pydict({"mb": [pages * 4096 / 1e6]})

    seen = []
    for _ in range(10):
        op7_langid.identify(docs, texts).count()
        docs.mapInArrow(op2_ngram_join._sketch(3), op2_ngram_join._SKETCH).count()
        seen.append(max(r[0] for r in spark.range(8).repartition(8).mapInArrow(resident, "mb double").collect()))
    assert max(seen[5:]) <= 1.1 * max(seen[:3]) + 10
