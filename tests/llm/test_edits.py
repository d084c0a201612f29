"""op11 to op13: plain versions, exhaustive searches, round trips."""

import random
import zlib
from collections import Counter, defaultdict
from functools import cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fairground.llm import config_packing, conv_repair, fim
from fairground.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")

# ---------------------------------------------------------------------------------------------
# op11


def units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return text.splitlines(keepends=True) if "\r" not in text and "\v" not in text else None
    out, blank = [], True
    for c in text:
        if c in " \t\n\v\f\r" and not blank or not out:
            out.append("")
        blank = c in " \t\n\v\f\r"
        out[-1] += c
    return out


def plain_fim(doc_id, text, rate=90, spm=20, seed=1, unit="char"):
    parts = units(text, unit)
    h = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(parts)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_units_and_ranked_bits():
    r = random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice("aé한😀 \n.b<P>") for _ in range(r.randint(0, 30)))
        raw = text.encode()
        for unit in ("char", "word", "line"):
            parts, ends = units(text, unit), fim.unit_ends(raw, unit)
            assert ends.bit_count() == len(parts), (text, unit)
            for k in range(1, len(parts) + 1):
                assert fim.select(ends, len(raw), k) + 1 == len("".join(parts[:k]).encode())


def test_fill_in_middle_on_odd_rows(spark):
    r = random.Random(2)
    texts = [None, "", "a", "é", "<P>", "x<M>y", "<", "<<<<>>>>", "<P<S<M", "P>S>M>", "\n\n\n", " ", "line\nline\r\nend", "한국어 😀👍🏽 é", "word " * 50000, "\x00a\x00"]
    texts += ["".join(r.choice("<>PSM é😀\n") for _ in range(r.randint(0, 25))) for _ in range(400)]
    rows = [*enumerate(texts), (3, "é"), (3, "é"), (None, "no id"), (-5, "less")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, `a.b` int, output string").repartition(3)
    for unit in ("char", "word"):
        made = fim.fill_in_middle(docs, unit=unit)
        got = Counter(tuple(x) for x in made.select("doc_id", "n", "form", "prefix_units", "middle_units", "output").collect())
        assert got == Counter((i, *plain_fim(i, t or "", unit=unit)) for i, t in rows)
        back = Counter(tuple(x) for x in made.select("doc_id", fim.restored(F.col("output"), F.col("form"))).collect())
        assert back == Counter((i, t or "") for i, t in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    assert {x.form for x in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(docs, unit="page")


def test_fill_in_middle_on_the_whole_table(spark):
    want = set()
    for x in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, form, a, m, out = plain_fim(x.doc_id, x.text or "")
        want.add((x.doc_id, n, form, a, m, sha256(out.encode()).hexdigest(), sha256((x.text or "").encode()).hexdigest()))
    assert {tuple(x) for x in QUERIES["op11_fill_in_middle"](spark, SF).collect()} == want
    assert {x[2] for x in want} == {"plain", "psm", "spm"}


# ---------------------------------------------------------------------------------------------
# op12


def cheapest(signature):
    """By trying all edits of every row, with up to two insertions before each and at the end."""
    @cache
    def best(i, state, inserted):
        found = [(0, "")] if i == len(signature) and state in (0, 3) else []
        to = 3 if state == 2 else 2
        if inserted < 3:
            c, a = best(i, to, inserted + 1)
            found.append((c + 3, "I" + a))
        if i < len(signature):
            sign = signature[i]
            more = 3 * sign.isupper()
            ways = [(4, "D", state)]
            if sign != "d":
                ways.append((3 + more, "R", to))
                if sign.lower() == "s" and state == 0:
                    ways.append((more, "K", 1))
                if sign.lower() == ("a" if state == 2 else "u"):
                    ways.append((more, "K", to))
            found += [(c + best(i + 1, to, 0)[0], x + best(i + 1, to, 0)[1]) for c, x, to in ways]
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def test_trie_against_all_edits():
    r = random.Random(3)
    some = sorted({"".join(r.choice("suaxSUAXd") for _ in range(r.randint(0, 11))) for _ in range(3000)})
    trie = conv_repair.Trie()
    assert [trie.solve(s) for s in some] == [cheapest(s) for s in some]
    assert trie.computed < sum(map(len, some))
    for long in ("d" * 50000, "uU" * 50000, "saXd" * 50000):  # layers repeat, memory is by row, time linear
        assert len(conv_repair.Trie().solve(long)[1]) >= len(long)


def plain_repair(rows):
    """rows: (conv_id, turn, role, text), not damaged yet, to the contract's columns."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(kind, text)
        kept = [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        convs[conv] += kept
    out = set()
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], sha256(t[2].encode()).digest()))
        seen, faults, signature = set(), Counter(), ""
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            sign = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signature += "d" if fault in ("blank", "duplicate") else sign.upper() if fault else sign
        cost, audit = cheapest(signature)
        made, at = [], iter(turns)
        for x in audit:
            row = next(at) if x != "I" else None
            follows = "assistant" if made and made[-1][:1] == "u" else "user"
            if x != "D":
                made.append(f"{row[1] if x == 'K' else follows}:{row[2] if row else ''}")
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out.add((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha256("\n".join(made).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_conversation_repair_on_odd_rows(spark):
    r = random.Random(4)
    rows = [(None, 0, "user", "no id."), (1, None, "user", "x."), (1, None, "assistant", None), (1, 4, None, "y."), (2, None, None, None), (3, 7, "system", "only."), (4, 0, "Ünknown", "."), (5, 0, "", "a."), (6, 0, "user", " "), (7, 0, "user", "z.\n\v ")]
    rows += [(conv, turn, r.choice(["user", "assistant", "system", "tool", None]), r.choice(["ok.", "ok", " ", "", None, "why?", "é!", "so\nit is."])) for conv in range(100, 400) for turn in r.choices([None, *range(6)], k=r.randint(1, 6))]
    rows += rows[20:60] + [(9, 2**40, "user", "far."), (9, -3, "assistant", "near.")] + [(10, i, ("user", "assistant")[i % 2], "long " * 20000 + ".") for i in range(30)]
    turns = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, `a.b` int").repartition(4)
    got = conv_repair.digest(conv_repair.damaged(turns))
    assert {tuple(x) for x in got.select(COLUMNS).collect()} == plain_repair(rows)
    assert conv_repair.digest(conv_repair.damaged(turns.limit(0))).count() == 0
    named = spark.createDataFrame([("a", 0, "assistant", "hi."), ("a", 1, "assistant", "hi."), ("b", 0, "user", " ")], "conv_id string, turn int, role string, text string")
    assert sorted(tuple(x) for x in conv_repair.repair(named).collect()) == [("a", 0, "user", "", "I"), ("a", 1, "assistant", "hi.", "K")]


def test_conversation_repair_on_the_whole_table(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(x) for x in QUERIES["op12_conversation_repair"](spark, SF).select(COLUMNS).collect()} == plain_repair(rows)


def test_repaired_turns_are_those_of_the_digest(spark):
    turns = conv_repair.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))
    made = defaultdict(list)
    for x in sorted(conv_repair.repair(turns).collect(), key=lambda x: (x.conv_id, x.position)):
        assert x.position == len(made[x.conv_id])
        made[x.conv_id].append(f"{x.role}:{x.text}")
    for x in conv_repair.digest(turns).collect():
        assert x.repaired_sha256 == sha256("\n".join(made[x.conv_id]).encode()).hexdigest()


# ---------------------------------------------------------------------------------------------
# op13


def held(chosen, capacity):
    got = Counter()
    for config, times in chosen:
        assert times > 0 and sum(s * k for s, k in config) <= capacity
        for s, k in config:
            got[s] += k * times
    return got


def test_plans_place_every_piece_close_to_the_bound():
    r = np.random.default_rng(1)
    count = lambda x: dict(Counter(int(v) for v in x))
    for counts, slack in (
        (count(np.clip(r.lognormal(4, 1, 40000), 1, 512)), 1.002), (count(r.integers(1, 513, 20000)), 1.03), (count(r.integers(125, 265, 20000)), 1.10),
        ({256: 999, 128: 3, 1: 10**9}, 1.001), ({171: 1000}, 1.6), ({1: 1}, 600), ({512: 7}, 1.0), ({200: 10**9, 112: 10**9, 17: 321}, 1.3), ({}, 1.0),
    ):
        chosen, bound = config_packing.plan(counts, 512)
        assert held(chosen, 512) == Counter(counts)
        assert sum(n for _, n in chosen) <= np.ceil(bound) * slack
    best = sum(config_packing.best_fit({171: 1000, 170: 1000, 340: 500}, 512).values())
    assert sum(n for _, n in config_packing.plan({171: 1000, 170: 1000, 340: 500}, 512)[0]) <= 1.01 * best


def test_rounds_use_fractions_better_than_best_fit():
    """Sizes of which best fit makes poor company: threes that only just fit together."""
    counts = {130: 600, 120: 600, 262: 600, 256: 300}
    chosen, bound = config_packing.plan(counts, 512)
    assert sum(n for _, n in chosen) <= min(sum(config_packing.best_fit(counts, 512).values()), 1.02 * bound)


def test_slots_number_every_piece_once():
    chosen = [(((3, 2), (5, 1)), 4), (((3, 1),), 3), (((5, 2),), 1)]
    slots = config_packing.Slots(chosen)
    places = Counter()
    for size, n in held(chosen, 11).items():
        sequence, offset = slots.find(np.full(n, size), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            places.update((s, o + i) for i in range(size))
    assert set(places.values()) == {1}
    rows = defaultdict(list)
    for s, o in places:
        rows[s].append(o)
    assert all(sorted(x) == list(range(len(x))) for x in rows.values()) and sorted(map(len, rows.values())) == [3, 3, 3, 10, 11, 11, 11, 11]


def check_pieces(rows, pieces, capacity):
    """rows: (doc_id, text); returns the number of sequences and of tokens."""
    tok = Tokenizer.from_file(PATH)
    own, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p.doc_id, p.piece].append(p)
        seqs[p.sequence_id].append((p.offset, p.length))
    want, total = Counter(), 0
    for doc_id, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        total += len(ids)
        for i, start in enumerate(range(0, len(ids), capacity)):
            cut = ids[start : start + capacity]
            want[doc_id, i, start, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for x in own.values() for p in x) == want
    for x in seqs.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return len(seqs), total


def test_best_fit_packing_on_the_whole_table(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n, total = check_pieces(rows, QUERIES["op13_best_fit_packing"](spark, SF).collect(), 4096)
    assert n <= -(-total // 4096) * 1.02 + 1


def test_best_fit_packing_on_odd_rows(spark):
    rows = [*enumerate([None, "", " ", "x" * 3000, "word. " * 900, "One two three.", "é😀"]), *[(7, "The same.")] * 400, (None, "no id"), (3, "x" * 3000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, `a.b` int, length int").repartition(5)
    n, total = check_pieces(rows, config_packing.pack(docs, PATH, capacity=64).collect(), 64)
    assert n <= -(-total // 64) * 1.05 + 1
    assert config_packing.pack(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        config_packing.pack(docs, PATH, capacity=0)
