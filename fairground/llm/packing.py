"""Packing of documents into token windows by order-preserving dynamic programming."""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fairground.llm.common import small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"
#: Cost of ending a window, in tokens of padding: anywhere, after a sentence, within one.
WINDOW_COST, SENTENCE_COST, INSIDE_COST = 16, 6, 20
#: Sentences longer than this get cuts inside, so many tokens apart.
STEP = 48
#: Tokens over which cuts are chosen together, and windows held back for the next round.
BLOCK_WINDOWS, HELD_WINDOWS = 128, 6
#: Words whose ids a Python worker remembers.
REMEMBERED_WORDS = 600_000

#: A word of Latin letters with or without punctuation after it: two pieces to the tokenizer, the first
#: of them the same in lower case. Apostrophes and angle brackets may begin pieces of other rules.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_PLAIN = rf"^(?P<stem>{_LETTERS})(?P<tail>[!\"#$%&()*+,./:;=?@\[\\\]^_`{{|}}~-]*)$"
#: Bytes of text whose words are looked up together.
TEXT_BYTES = 8 << 20
#: Stands for the end of a word; no letter's bytes hold it.
_END = "\x01"

_TOKENIZERS: dict[str, _Words] = {}


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves,
    the others in order from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class _Words:
    """The ids of words, each encoded once and remembered, in one buffer.

    Letters are encoded by the same merges in a faster library: every token of the vocabulary encodes to
    itself, so the lowest rank among neighbours' joined bytes names the merge that the tokenizer would
    make. Everything else goes through the tokenizer as it is."""

    def __init__(self, path: str) -> None:
        # tasks share the cores already; threads of the library's own would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        signs, ranks = _byte_of_sign(), {}
        self.word_ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            stem = token.removesuffix("</w>")
            raw = bytes(signs[c] for c in stem)
            if _END.encode() not in raw or len(raw) == 1 and stem == token:
                self.word_ends[i] = stem != token
                ranks[raw + _END.encode() if stem != token else raw] = i
        self.letters = tiktoken.Encoding("letters", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        self.sentence_ends = np.zeros(max(vocab.values()) + 2, dtype=bool)
        self.sentence_ends[[i for t, i in vocab.items() if re.fullmatch(r"""[.!?]+["')\]]*(</w>)?""", t)]] = True
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.ids, self.held = np.empty(1 << 16, dtype="<u4"), 0
        self.start, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n = len(self.at), len(words)
        while self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while first + n > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.ids[self.held : self.held + len(ids)] = ids
        self.start[first : first + n] = self.held + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.held += len(ids)
        self.at.update(zip(words, range(first, first + n), strict=True))

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of these different words are; new ones are encoded."""
        if not len(words):
            return np.zeros(0, dtype=np.int64)
        names = _strings(words)
        new = np.fromiter((w not in self.at for w in names), bool, len(names))
        if new.any():
            letters = new & pc.match_substring_regex(words, f"^{_LETTERS}$").to_numpy(zero_copy_only=False)
            stems = _strings(words.filter(pa.array(letters)))
            rest = _strings(words.filter(pa.array(new & ~letters)))
            if stems:
                ids = self.letters.encode_to_numpy(_END.join([*stems, ""]), disallowed_special=())
                self._add(stems, ids, np.diff(np.flatnonzero(self.word_ends[ids]) + 1, prepend=0))
            if rest:
                found = [e.ids for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
                self._add(rest, np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64))
        return np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, _PLAIN)
        stems = pc.coalesce(pc.utf8_lower(pc.struct_field(parts, "stem")), coded.dictionary).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(parts, "tail"), "").dictionary_encode()
        if len(self.at) + len(stems.dictionary) + len(tails.dictionary) > REMEMBERED_WORDS:
            self.forget()
        at = np.stack([self.places(x.dictionary)[x.indices.to_numpy()] for x in (stems, tails)], axis=1)
        ids, sizes = _gather(self.ids, self.start, self.size, at.ravel())
        sizes = sizes.reshape(-1, 2).sum(1)
        ids, sizes = _gather(ids, np.cumsum(sizes) - sizes, sizes, coded.indices.to_numpy())
        upto = np.concatenate(([0], np.cumsum(sizes)))[ends]
        return [ids[a:b] for a, b in zip(upto, upto[1:], strict=False)]


def _strings(words: pa.Array) -> list[str]:
    """Words without blanks as strings: joined and split again, much faster than one after another."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


def _gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words at these places, one after another, and how many each has."""
    sizes = size[places]
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    return ids[np.repeat(start[places] - upto + sizes, sizes) + np.arange(total)], sizes


def _words(path: str) -> _Words:
    """The words of a tokenizer, once per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Words(path)
    return _TOKENIZERS[path]


def encode(batches, path: str):
    """doc_id and the ids of every whole text, TEXT_BYTES of text or a batch at a time. Words between
    blanks and line feeds are encoded one by one and remembered: the tokenizer never joins over white
    space, so the ids are those of the text."""
    held, size = [], 0
    for batch in chain(batches, [None]):
        if held and (batch is None or size + batch.nbytes > TEXT_BYTES):
            texts = pa.concat_arrays([b.column(1) for b in held])
            names = chain.from_iterable(b.column(0).to_pylist() for b in held)
            yield from zip(names, _words(path).encode(texts), strict=True)
            held, size = [], 0
        if batch is not None:
            held.append(batch)
            size += batch.nbytes


def choose_cuts(pos: list[int], cost: list[int], window: int, powers: list[int]) -> list[int]:
    """Positions of the best cuts, the last of pos included.

    pos: the positions where a cut may fall, from 0, gaps of at most window; cost: of a cut there.
    best[j] = cost[j] + min over i of best[i] + padding(pos[j] - pos[i]), at most a window apart.
    padding is window - length, so the minimum of best[i] + pos[i] over a sliding range is needed: a
    monotone queue gives it in constant time per position. Lengths in powers aren't padded."""
    n = len(pos)
    best, back = [0] * n, [0] * n
    queue: deque = deque([(0, 0, 0)])  # best + pos, pos, index; the first is the least
    at = {0: 0} if powers else {}
    for j in range(1, n):
        p = pos[j]
        while p - queue[0][1] > window:
            queue.popleft()
        least, _, i = queue[0]
        b = least + window - p
        for length in powers:
            k = at.get(p - length)
            if k is not None and best[k] < b:
                b, i = best[k], k
        b += cost[j] + WINDOW_COST
        best[j], back[j] = b, i
        key = b + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
        if powers:
            at[p] = j
    cuts, j = [], n - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


def _candidates(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray, window: int, last: bool) -> tuple[list[int], list[int]]:
    total = len(ids)
    cost = np.full(total + 1, -1, dtype=np.int64)
    sentence = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    cost[sentence] = SENTENCE_COST
    inner = doc_ends[doc_ends <= total]
    cost[inner] = 0
    cost[0] = cost[total] = 0
    pos = np.flatnonzero(cost >= 0)
    gaps = np.diff(pos)
    for g in np.flatnonzero(gaps > STEP):
        cost[pos[g] + STEP : pos[g + 1] : STEP] = INSIDE_COST
    if last:  # at the end any length may come out as a power of two
        tail = cost[max(0, total - window) :]
        tail[tail < 0] = INSIDE_COST
    pos = np.flatnonzero(cost >= 0)
    return pos.tolist(), cost[pos].tolist()


def _pack_partition(batches, path: str, window: int, end_id: int):
    ends = _words(path).sentence_ends
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    made, held, docs = 0, [], []  # held: arrays of ids; docs: doc_id, tokens, position of its first token
    size, end = 0, np.array([end_id], dtype="<u4")

    def flush(last: bool):
        nonlocal made, held, docs, size
        ids = np.concatenate(held)
        first = np.array([d[2] for d in docs], dtype=np.int64)
        count = np.array([d[1] for d in docs], dtype=np.int64)
        powers = [1 << k for k in range(window.bit_length()) if 1 << k < window] if last else []
        pos, cost = _candidates(ids, ends, first + count, window, last)
        cuts = choose_cuts(pos, cost, window, powers)
        if not last:
            cuts = cuts[:-HELD_WINDOWS]
        done = cuts[-1]
        cut = np.array([0, *cuts], dtype=np.int64)
        bounds = np.unique(np.concatenate((cut, first[(first > 0) & (first < done)])))
        begin, length = bounds[:-1], np.diff(bounds)
        doc = np.searchsorted(first, begin, side="right") - 1
        seq = np.searchsorted(cut, begin, side="right") - 1
        sizes = np.diff(cut)
        padded = np.where((sizes & (sizes - 1)) == 0, sizes, window)
        raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
        out = pa.record_batch({
            "doc_id": pa.array([docs[d][0] for d in doc], pa.int64()),
            "start": pa.array(begin - first[doc]),
            "length": pa.array(length),
            "ids_crc32": pa.array([zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)], pa.int64()),
            "doc_tokens": pa.array(count[doc]),
            "sequence_id": pa.array(seq + made + (part << 32)),
            "offset": pa.array(begin - cut[seq]),
            "padded_to": pa.array(padded[seq]),
        })
        made += len(cuts)
        held, size = ([ids[done:].copy()], len(ids) - done)
        docs = [(d, n, p - done) for d, n, p in docs if p + n > done]
        return out

    for doc_id, ids in encode(batches, path):
        docs.append((doc_id, len(ids) + 1, size))
        held += [ids, end]
        size += len(ids) + 1
        if size >= BLOCK_WINDOWS * window:
            yield flush(False)
    if size:
        yield flush(True)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents, in the order of the table, into windows of at most `window` tokens.

    Every partition of the table is a stream of its own: its documents' ids (and `end_id` after
    each) follow one another, and the cuts between windows minimise padding plus the cost of ending a
    window inside a document. No shuffle, and only the tokens of a batch of documents and of some windows are held
    at a time. A lost task packs the same rows into the same windows again; window numbers carry the partition's.

    Returns the pieces: which ids of which document lie where. Windows are padded to `window`, except
    where their length is a power of two. Null and empty texts are documents of one token. Repeated
    rows are packed as often as they occur, a null id stays null, an empty table gives no pieces, and
    columns besides the two named are ignored."""
    small_batches(docs.sparkSession)
    run = partial(_pack_partition, path=tokenizer, window=window, end_id=end_id)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
