"""Repair of conversations by the cheapest edits: one dynamic program over a trie of all their signatures."""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fairground.llm.common import scratch, small_batches

#: Costs of edits; a truncated row that stays costs TRUNCATED more.
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
#: White space of a text, and what ends a sentence.
_BLANKS, _ENDS = " \t\n\v\f\r", ".!?"
#: Neighbours whose role initials are in order.
_LEGAL = ("su", "ua", "au")
#: Sign of a row that has to go; the others are the role's initial (x: of no known role), in upper case if truncated.
GONE = "d"

# ---------------------------------------------------------------------------------------------
# damage, faults and signatures


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: rows as an unreliable log would leave them. Null roles and texts are
    one space. By the CRC-32 of `conv_id:turn` a row in 20 each is lost (there is false), emptied, robbed of its
    sentence ends, repeated, or given to the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", _ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), copies).drop("copy")


def _key(text: Column) -> Column:
    """What stands for a text where only its equality and an order matter."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def signatures(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text, there. Per conversation its gaps, counts of faults and signature: a
    sign for every row in order (turn, nulls first; role; digest of the text).

    Only digests of the texts are shuffled, by conversation; rows are ordered within their task, which spills,
    and what is gathered of a row is its sign."""
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    short = rows.select("conv_id", "turn", "role", "there", _key(F.col("text")).alias("key"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*_ENDS)).alias("open"))
    order = [F.col("turn").asc_nulls_first(), "role", "key"]
    by = W.partitionBy("conv_id", "there").orderBy(*order)
    again = F.row_number().over(W.partitionBy("conv_id", "there", "role", "key").orderBy(F.col("turn").asc_nulls_first())) > 1
    first = F.left("role", F.lit(1))
    short = short.repartition("conv_id").withColumn("again", again)
    short = short.withColumn("place", F.row_number().over(by)).withColumn("pair", F.concat(F.lag(first).over(by), first)).withColumn("new", ~F.col("turn").eqNullSafe(F.lag("turn").over(by)))
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    known = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    sign = F.when(F.col("blank") | F.col("again"), GONE).when(F.col("open"), F.upper(known)).otherwise(known)
    short = short.withColumn("fault", F.when(F.col("there"), fault)).withColumn("sign", sign)
    count = lambda c: F.count_if(F.col("there") & c)
    turn = F.when(F.col("there"), F.col("turn"))
    per = short.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_if(F.col("there") & F.col("new") & turn.isNotNull()), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")],
        count(F.col("pair").isNotNull() & ~F.col("pair").isin(*_LEGAL)).alias("illegal"),
        F.sort_array(F.collect_list(F.when(F.col("there"), F.struct("place", "sign")))).alias("signs"),
    )
    return per.withColumn("signature", F.array_join("signs.sign", "")).drop("signs")


# ---------------------------------------------------------------------------------------------
# the dynamic program: what is out so far is nothing, a system turn, or ends with a user's or an assistant's

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: A layer: per state its cost above the cheapest (None: not reachable), and for each pair of states how their
#: least audits go on after what both begin with. There are few different layers, however many rows.
Layer = tuple[tuple, tuple]


def _apart(a: str, b: str) -> tuple[str, str]:
    """Two strings after their common prefix; of strings that differ there one letter each is enough."""
    n = len(commonprefix([a, b]))
    a, b = a[n:], b[n:]
    return (a[:1], b[:1]) if a and b else (a, b)


def _step(rests: tuple, ways: list[tuple]) -> tuple[int, tuple, Layer]:
    """ways: (state reached, cost, state before, letters). The least cost, per state (state before, letters) of
    its cheapest way, of equals the one with the least audit, and the layer.

    Equally dear audits over the same rows aren't one another's prefix (only an insertion, which costs, makes
    one longer), so the lesser stays the lesser whatever follows: a layer needs no more than these."""
    def apart(a: tuple, b: tuple) -> tuple[str, str]:
        left, right = rests[a[2]][b[2]] if a[2] != b[2] else ("", "")
        return _apart(left + a[3], right + b[3])

    def better(a: tuple | None, b: tuple) -> tuple:
        if a is None or a[1] != b[1]:
            return b if a is None or b[1] < a[1] else a
        left, right = apart(a, b)
        return a if left <= right else b

    best: list[tuple | None] = [None] * 4
    for way in ways:
        best[way[0]] = better(best[way[0]], way)
    for before, to in ((NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
        if best[before] is not None:
            _, cost, source, letters = best[before]
            best[to] = better(best[to], (to, cost + INSERT, source, letters + "I"))
    if best[ASSISTANT] is not None:  # whatever follows these can follow it as well, but for a system turn, deleted then
        for state, more in ((NOTHING, DELETE), (SYSTEM, 0)):
            if best[state] is not None and best[state][1] > best[ASSISTANT][1] + more:
                best[state] = None
    least = min(w[1] for w in best if w is not None)
    pairs = tuple(tuple(apart(a, b) if a and b else ("", "") for b in best) for a in best)
    return least, tuple(w and (w[2], w[3]) for w in best), (tuple(w and w[1] - least for w in best), pairs)


_START = _step(((("", ""),) * 4,) * 4, [(NOTHING, 0, NOTHING, "")])


@lru_cache(maxsize=1 << 14)
def _after(layer: Layer, sign: str) -> tuple[int, tuple, Layer]:
    """The layer after one more row."""
    costs, rests = layer
    ways, role, extra = [], sign.lower(), TRUNCATED if sign.isupper() else 0
    for state, cost in enumerate(costs):
        if cost is None:
            continue
        ways.append((state, cost + DELETE, state, "D"))
        if sign == GONE:
            continue
        follows = ASSISTANT if state == USER else USER
        ways.append((follows, cost + REROLE + extra, state, "R"))
        if role == "s" and state == NOTHING:
            ways.append((SYSTEM, cost + KEEP + extra, state, "K"))
        if role == ("a" if state == USER else "u"):
            ways.append((follows, cost + KEEP + extra, state, "K"))
    return _step(rests, ways)


class Trie:
    """The path of a prefix trie down to the last signature. Signatures come sorted, so what the next one shares
    with the last are the layers at the head of the path, computed once for all that share them."""

    def __init__(self) -> None:
        self.path, self.layers = "", [_START]
        self.computed = 0

    def solve(self, signature: str) -> tuple[int, str]:
        """The cost and the letters of the cheapest edits."""
        shared = len(commonprefix([self.path, signature]))
        del self.layers[shared + 1 :]
        for sign in signature[shared:]:
            self.layers.append(_after(self.layers[-1][2], sign))
        self.computed += len(signature) - shared
        self.path = signature
        costs, rests = self.layers[-1][2]
        state = NOTHING
        if costs[state] is None or costs[ASSISTANT] is not None and (costs[ASSISTANT], rests[ASSISTANT][NOTHING][0]) < (costs[NOTHING], rests[ASSISTANT][NOTHING][1]):
            state = ASSISTANT
        cost, letters = costs[state] + sum(layer[0] for layer in self.layers), []
        for _, ways, _ in reversed(self.layers):
            state, own = ways[state]
            letters.append(own)
        return cost, "".join(reversed(letters))


_EDITS = "cost long, audit string"


def _solved(batches):
    trie = Trie()
    for batch in batches:
        found = [trie.solve(s) for s in batch.column("signature").to_pylist()]
        costs, audits = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=[*batch.schema.names, "cost", "audit"])


def edits(per: DataFrame) -> DataFrame:
    """per: conversations with a signature. The same with cost and audit (K keep, R rerole, D delete, I insert,
    in order). Conversations are dealt out in the order of their signatures, so that each task walks one part of the
    trie; those of one signature, however many, are split over tasks by their id."""
    dealt = per.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature", "conv_id")
    kinds = ", ".join(f"{c} {t}" for c, t in per.dtypes)
    return dealt.mapInArrow(_solved, f"{kinds}, {_EDITS}")


# ---------------------------------------------------------------------------------------------
# the repaired conversations


class _Conversation:
    """Applies the letters of an audit to the rows of a conversation as they pass by."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.last = audit, 0, None

    def _next(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def _out(self, role: str, text: str, letter: str) -> tuple[str, str, str]:
        self.last = role[:1]
        return role, text, letter

    def inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._out(self._next(), "", "I")

    def row(self, role: str, text: str):
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield self._out(role if letter == "K" else self._next(), text, letter)


def _streams(batches, begin, add, end):
    """Rows sorted by conversation, its audit before its turns: begin(audit row), add(state, role, text, letter)
    for each repaired turn, end(state). One batch of turns is held at a time."""
    now = state = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if now is not None:
                    out += [x for turn in now.inserted() for x in add(state, *turn)] + end(state)
                now, state = _Conversation(row["audit"]), begin(row)
            else:
                out += [x for turn in now.row(row["role"], row["text"]) for x in add(state, *turn)]
        yield out
    if now is not None:
        yield [x for turn in now.inserted() for x in add(state, *turn)] + end(state)


def _rows_of(batches, schema: pa.Schema):
    def add(state, role, text, letter):
        state["n"] += 1
        return [{"conv_id": state["conv_id"], "position": state["n"], "role": role, "text": text, "edit": letter}]

    for out in _streams(batches, lambda row: {"conv_id": row["conv_id"], "n": -1}, add, lambda _: []):
        yield pa.RecordBatch.from_pylist(out, schema=schema)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digests_of(batches, schema: pa.Schema):
    def add(state, role, text, _letter):
        state["hash"].update(f"{state['between']}{role}:{text}".encode())
        state["between"] = "\n"
        return []

    def begin(row):
        return {"row": {c: row[c] for c in ("conv_id", *_COUNTS, "audit")}, "hash": sha256(), "between": ""}

    for out in _streams(batches, begin, add, lambda s: [{**s["row"], "repaired_sha256": s["hash"].hexdigest()}]):
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _sorted(rows: DataFrame) -> DataFrame:
    """Every conversation's audit and counts, then its rows in the order of its signature."""
    answers = scratch(edits(scratch(signatures(rows), "signatures")), "edits")
    there = rows.where("there").select("conv_id", "turn", "role", "text", _key(F.col("text")).alias("key"))
    whole = there.unionByName(answers.drop("signature"), allowMissingColumns=True)
    dealt = whole.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "key")
    return dealt.select("conv_id", "role", "text", "audit", *_COUNTS)


def _kind(turns: DataFrame, name: str) -> tuple[str, pa.DataType]:
    kind = dict(turns.dtypes)[name]
    return kind, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def repair(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text (and there, if some are lost). The turns of the cheapest conversations
    that begin with a system turn at most and then alternate between user and assistant, who has the last word.

    Returns conv_id, position (from 0), role, text, edit (K, R or I). A blank or repeated turn is deleted; any turn may
    be; a turn may be given to user or assistant, an empty one inserted. A conversation of which nothing is left has
    no rows. Turns are ordered by turn (nulls first), role and digest of the text; a null conv_id is one of its own; null
    roles and texts count as one space. Other columns are ignored; an empty table gives no rows.

    A conversation's turns pass through one task in order, a batch at a time; its signature and audit (a letter a
    turn) are one value each, which bounds a conversation by the size of a value."""
    small_batches(turns.sparkSession)
    kind, arrow = _kind(turns, "conv_id")
    schema = pa.schema([("conv_id", arrow), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    return _sorted(_given(turns)).mapInArrow(lambda b: _rows_of(b, schema), f"conv_id {kind}, position long, role string, text string, edit string")


def _given(turns: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" ")).alias(c)
    return turns.select("conv_id", "turn", blank("role"), blank("text"), turns["there"] if "there" in turns.columns else F.lit(True).alias("there"))


def digest(turns: DataFrame) -> DataFrame:
    """Per conversation the contract's columns: its faults, the cost and the letters of its repair, and the SHA-256
    of the turns that repair() gives out, joined as `role:text` by line feeds."""
    small_batches(turns.sparkSession)
    kind, arrow = _kind(turns, "conv_id")
    schema = pa.schema([("conv_id", arrow), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    columns = ", ".join([f"conv_id {kind}", *[f"{c} long" for c in _COUNTS], "audit string", "repaired_sha256 string"])
    return _sorted(_given(turns)).mapInArrow(lambda b: _digests_of(b, schema), columns)
