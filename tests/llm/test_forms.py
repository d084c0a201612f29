"""op1, op3, op6, op8, op10 and the pipeline: round trips, laws, held-out accuracy, plain versions."""

import hashlib
import time
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fairground.llm import chat, html_mincut, langid, packing, pii, sharding
from fairground.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check_packing(rows, pieces):
    """rows: (doc_id, text) with doc_ids all different."""
    tok = Tokenizer.from_file(PATH)
    own, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
    assert set(own) == set(rows)
    for doc_id, text in rows.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(own[doc_id], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()), text
            at += p.length
        assert at == len(ids)
    padded = total = 0
    for x in seqs.values():
        at = 0
        for p in sorted(x, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 2048
        total += at
        padded += at if at & (at - 1) == 0 else 2048
    return total, padded


def test_packing_on_a_whole_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total, padded = check_packing(rows, QUERIES["op1_packing"](spark, SF).collect())
    assert padded < 1.03 * total


def test_packing_on_odd_rows(spark):
    rows = dict(enumerate([None, "", " ", "a\tb\nc d e", "Don't stop-now... 3.14 x.y, U.S. 50% <|endoftext|>", "İstanbul ſtraße 😀👍🏽 é 한국어 中文。", "x" * 9000, "word. " * 6000, "...,,, .a ,b 1, 2.",
                           "O'Neil's isn't 'tis x' y'' ÀÉ!! Straße... naïve?! e\u0301a cafe\u0301. a\x01b \x01 c\x01 µm ªº ×÷ ﬁn don<|endoftext|>t end<|endoftext|> a_b _x_ (ab) [c]: d-e f- Ÿ ÿ~", "Å \u00c5 A\u030a \u212b K \u212a"]))
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows.items()], "doc_id long, text string, start int").repartition(2)
    check_packing(rows, packing.pack(docs, PATH).collect())
    assert packing.pack(docs.limit(0), PATH).count() == 0
    assert packing.pack(docs.selectExpr("CAST(NULL AS long) AS doc_id", "text"), PATH).where("doc_id IS NULL").count() > 0


def test_tokens_encode_to_themselves():
    """What the faster encoding of letters rests on."""
    tok, signs = Tokenizer.from_file(PATH), packing._byte_of_sign()
    words = {}
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            stem = bytes(signs[c] for c in token.removesuffix("</w>")).decode()
        except UnicodeDecodeError:
            continue
        if token.endswith("</w>") and stem.isalpha() and stem == stem.lower():
            words[stem] = i
    assert len(words) > 10000
    for found, i in zip(tok.encode_batch_fast(list(words), add_special_tokens=False), words.values(), strict=True):
        assert found.ids == [i]
    stems = [w * n for w in list(words)[::7] for n in (1, 2, 3)]
    whole = packing._words(PATH).letters.encode_to_numpy("\x01".join([*stems, ""]), disallowed_special=())
    assert whole.tolist() == [i for e in tok.encode_batch_fast(stems, add_special_tokens=False) for i in e.ids]


def test_cuts_are_the_best(spark):
    """Against all ways to cut, over short streams."""
    rng = np.random.default_rng(3)
    for powers in ([], [1, 2, 4]):
        for _ in range(60):
            pos = [0, *np.cumsum(rng.integers(1, 5, 9)).tolist()]
            cost, window = [0, *rng.integers(0, 9, 9).tolist()], 8
            best = {0: 0}
            for j in range(1, 10):
                ways = [best[i] + (0 if pos[j] - pos[i] in powers else window - (pos[j] - pos[i])) for i in range(j) if pos[j] - pos[i] <= window]
                best[j] = min(ways) + cost[j] + packing.WINDOW_COST
            cuts = [0, *packing.choose_cuts(pos, cost, window, powers)]
            at = {p: i for i, p in enumerate(pos)}
            got = sum((0 if b - a in powers else window - (b - a)) + cost[at[b]] + packing.WINDOW_COST for a, b in zip(cuts, cuts[1:], strict=False))
            assert cuts[-1] == pos[-1] and got == best[9]


def test_html(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
    <article><h1>Big  news</h1><p>First&nbsp;paragraph of the story &amp; more words that make it long enough to read.</p><p>Second paragraph with an <b>inline</b> element and words enough.</p></article>
    <aside class=sidebar><p>Related things</p></aside><div class="comments"><p>nice post</p></div><form><input></form><script>x()</script><footer>Copyright</footer></body></html>"""
    rows = [(0, "u", page, 1), (1, None, None, 1), (2, "u", "", 1), (None, "u", "<p>", 1), (4, "u", "<div>" * 3000 + "deep", 1)]
    found = {r.page_id: r for r in html_mincut.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert found[0].text == "Big news\nFirst paragraph of the story & more words that make it long enough to read.\nSecond paragraph with an inline element and words enough."
    assert found[1].text == found[2].text == "" and found[0].n_chars == len(found[0].text) and len(found) == 5
    assert QUERIES["op3_html_extraction"](spark, SF).where("n_chars <> length(text)").count() == 0


def test_html_of_unclosed_tags():
    """A megabyte of elements that nobody closes is parsed in time that grows with its length."""
    began = time.process_time()
    for unit in ("<i>x<hr>", "<p><b>y", "<button><i>x<hr>", "</p></i></x>z", "<li><ul>x", "<td>x"):
        html_mincut.main_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 120
    prose = "a long sentence of plain words that goes on and on until it is surely prose"
    page = f"<article><p><span class=ad>Ad!</span> {prose}</p><p>{prose}</p></article><div class=sidebar><p><b>x</b> {prose}</p></div>"
    assert html_mincut.main_text(page) == f"Ad! {prose}\n{prose}"


def test_min_cut(spark):
    """Against all labellings of small graphs."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = 6
        source, sink = rng.integers(0, 9, n).tolist(), rng.integers(0, 9, n).tolist()
        edges = [(a, b, int(rng.integers(0, 6))) for a in range(n) for b in range(a)]
        price = lambda x: sum(sink[i] if x[i] else source[i] for i in range(n)) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, E731
        assert price(html_mincut.min_cut(source, sink, edges)) == min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


def test_sharding(spark):
    rows = QUERIES["op6_sharding"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    per = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        per[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in per.values()) and set(per) <= set(range(40))
    odd = spark.createDataFrame([(1, None, 3), (1, "a", 3), (None, "b", 3), (None, None, 3), (1, "a", 3)], "doc_id long, text string, size int")
    assert sharding.shard(odd, 4).count() == 5 and sharding.shard(odd.limit(0), 4).count() == 0


def plain_map(totals, shards):
    load, to = [0] * shards, {}
    for slot, size in sorted(totals.items(), key=lambda x: (-x[1], x[0])):
        to[slot] = load.index(min(load))
        load[to[slot]] += size
    return to


def check_shards(rows, shards):
    """Near equal bytes, gapless slots, and the map that a plain fold over the slots gives."""
    load, totals, places = dict.fromkeys(range(shards), 0), defaultdict(int), defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        totals[r.virtual_slot] += r.size
        places[r.shard].append(r.slot)
    want = plain_map(totals, shards)
    assert all(want[r.virtual_slot] == r.shard for r in rows) and all(sorted(x) == list(range(len(x))) for x in places.values())
    assert {r.rebalanced_shard for r in rows if r.rebalanced_shard != r.shard} <= {shards}
    return load


def test_shards_are_balanced(spark):
    for rows in ("id AS doc_id", "7L AS doc_id", "CAST(NULL AS long) AS doc_id", "IF(id % 3 = 0, 7L, id) AS doc_id"):
        docs = spark.range(20000).selectExpr(rows, "repeat('x', int(pmod(hash(id), 90))) AS text", "1 AS place", "'k' AS key")
        load = check_shards(sharding.shard(docs, 8).collect(), 8)
        assert max(load.values()) < 1.02 * min(load.values())


def test_stored_map(spark, tmp_path):
    path = f"{tmp_path}/map"
    docs = spark.range(3000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    sharding.shard(docs, 4, map_path=path)
    first, last = sharding.read_map(spark, path, 1).collect(), sharding.read_map(spark, path).collect()
    assert {r.shard for r in first} == set(range(4)) and {r.shard for r in last} == set(range(5)) and {r.version for r in last} == {2}
    old = {r.virtual_slot: r.shard for r in first}
    assert all(r.shard in (4, old[r.virtual_slot]) for r in last) and len(first) == len(last)


def test_slot_map_is_edited(spark):
    totals = sharding.slot_bytes(sharding.with_slots(spark.range(20000).selectExpr("id AS doc_id", "repeat('x', int(id % 90)) AS text"))).cache()
    old = sharding.first_map(totals, 8)
    new = sharding.edit_map(old, totals, 9, 2)
    moved = old.alias("o").join(new.alias("n"), "virtual_slot").where("o.shard <> n.shard")
    assert {r.shard for r in moved.select("n.shard").distinct().collect()} == {8}
    loads = [r.b for r in new.join(totals, "virtual_slot").groupBy("shard").agg({"bytes": "sum"}).toDF("shard", "b").collect()]
    assert max(loads) < 1.1 * min(loads) and len(loads) == 9


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out and r.lang]
    assert len(found) == docs.count() and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    model = langid.fit(spark.createDataFrame([(1, "the cat", "en", 1), (2, None, "en", 1), (3, "die Katze", "de", 1), (4, "x", None, 1)], "doc_id long, text string, lang string, score int"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34"), (4, "die " * 300000), (None, "cat")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred == "de" and len(got) == 5
    empty = langid.fit(odd.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"))
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


def test_chat(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    rows = [tuple(r) for r in rows] + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    check_chat(rows, QUERIES["op10_chat_formatting"](spark, SF).collect())


def check_chat(rows, found):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        convs[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    assert len(found) == len(convs)
    for r in found:
        turns = sorted(convs[r.conv_id])
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_on_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, "assistant", "&lt;s&gt;<s>&amp;&lb;[x]"), (2, None, None, "n"), (3, 0, "system", "only"), (None, 0, "assistant", "x\ny"), (4, 0, "assistant", "a</s>"), (4, 0, "assistant", "a</s>"), (5, 0, "role\n<s>", "t" * 50000), (5, 1, "assistant", "😀")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string")
    check_chat(rows, chat.read_back(chat.format_chat(table)).collect())
    assert chat.format_chat(table.limit(0)).count() == 0


def test_classes_of_the_whole_page_say_nothing():
    """Body, or all that holds the article and nearly everything else, may be called what it likes."""
    prose = " ".join(["Some words of an article that go on for a while, with commas."] * 4)
    inner = f"<nav><a href=x>Home</a> <a href=y>More</a></nav><article><h1>Title</h1><p>{prose}</p><p>{prose}</p></article><div class=sidebar>Also here</div><footer>Copyright 2020 us</footer>"
    want = f"Title\n{prose}\n{prose}"
    for name in ("", "page has-sidebar", "nav-open", "single post comments-open", "cookie-notice-seen", "ad advert sponsored"):
        assert html_mincut.main_text(f"<html class='{name}'><body class='{name}' id='comments'>{inner}</body></html>") == want
        assert html_mincut.main_text(f"<body><div id='{name}'><div class='{name}'>{inner}</div></div><p></p></body>") == want
    # what holds all of a page but no article is still what it is called
    for name in ("sidebar", "comments", "cookie-notice"):
        assert html_mincut.main_text(f"<body><div class='{name}'><p>{prose}</p><p>{prose}</p></div></body>") == ""


def test_pipeline_stages_with_odd_rows(spark):
    """Columns of any name, repeated rows, nulls, ties and empty tables pass every stage but the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = ["score", "lang_pred", "row", "_text_", "digest", "rep", "rows_", "least_", "text_", "h_", "email_m", "terms", "now_", "sanitised_", "sanitised_0", "id", "component", "doc", "a.b", "x`y", "row.text"]
    wide = docs.limit(60).select("*", *[F.lit(f"own {c}").alias(c) for c in clash])
    wide = wide.union(wide.limit(5)).union(wide.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).union(wide.limit(2).withColumn("text", F.lit(None).cast("string")))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (wide, wide.limit(0)):
            out = stage(spark, rows, SF).collect()
            if name != "packing":
                assert all(r[c] == f"own {c}" for r in out for c in clash) and len(out) <= rows.count()
            assert bool(out) == bool(rows.count())


def test_pipeline_against_plain_stages(spark):
    """Every stage by itself: what it keeps is right for its own input, nothing else changes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "minhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == names and kept.count() >= 0.97 * docs.count()
    from test_groups import components, grams, shingles

    rows = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: shingles(t) for i, t in rows.items()}
    links = [(a, b) for a in rows for b in rows if a < b and sets[a] and sets[b] and 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    single = {i for i, c in components(rows, links).items() if i == c}
    assert {r.doc_id for r in stages["minhash_near_dedup"](spark, docs, SF).collect()} == single
    items = [g for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (g := grams(r.text))]
    clean = {i for i, t in rows.items() if not any(len(grams(t) & g) >= 0.75 * len(g) for g in items)}
    assert {r.doc_id for r in stages["benchmark_decontamination"](spark, docs, SF).collect()} == clean
    safe = stages["pii"](spark, docs, SF)
    assert safe.dtypes == docs.dtypes and safe.count() == docs.count()
    assert pii.digest(safe).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in whole} <= single & clean and len(whole)
