"""BPE encoding and decoding through a deterministic automaton over tokens.

The automaton starts as one state with an arc to itself for every byte. Each merge ``(a, b) -> c``,
in order, applies a gadget: arcs labelled ``a`` now lead to a copy of their target that lacks the arc
``b``, and every state with an arc ``a`` gets an arc ``c`` to where ``b`` led. The result accepts just
the token sequences that applying the merges yields, so a word has exactly one accepting path.

All arcs of one label lead to one state, hence the tables stay small: per label its state, per state
its parent (the state it was copied from, and when) and the arcs it lost (and when). An arc ``c`` is
present where its left part ``a`` was when ``c`` was made. ``Automaton.step`` reads these tables.

Null texts count as empty and give no ids and the empty text. A word takes time in proportion to its length, however long. Special tokens in a text become their
own ids, as the vocabulary file says. Repeated rows are encoded one by one.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidepool.llm.runtime import prepare
from tidepool.llm.textbuf import slices

#: Fixed value of byte-level vocabularies: the split of a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words whose ids one worker remembers, twice over.
MEMO_WORDS = 200_000
#: Pairs of tokens of which one worker remembers whether they can follow each other.
MEMO_STEPS = 400_000
LONG_WORD = 64
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    return letters | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if chr(x) not in letters)}


def pack(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


class Memo(dict):
    """Ids of the words met lately. When full, what it holds becomes ``old``, from which words come back on use; long words pass through."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.old = automaton, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = pack(self.automaton.encode_word(word.encode()))
        if len(word) <= LONG_WORD:
            if len(self) >= MEMO_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Automaton:
    """Tables of the automaton of one vocabulary; ``merges`` are (left, right, merged) ids in order."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], specials: dict[str, int]):
        self.labels, self.specials = labels, specials
        self.target = dict.fromkeys((t for t, b in labels.items() if len(b) == 1), 0)
        self.parent: list[tuple[int, int]] = [(-1, -1)]  # (state copied, before which merge)
        self.lost: dict[tuple[int, int], int] = {}  # (state, label) -> merge that took the arc
        self.left: dict[int, tuple[int, int]] = {}  # label -> (its left part, its merge)
        users = {0: len(self.target)}
        self.memo: dict[int, bool] = {}
        for k, (a, b, c) in enumerate(merges):
            if a not in self.target or b not in self.target or c in self.target or not self.step(a, b, k):
                continue
            self.memo.clear()
            goal = self.target[b]
            self.target[c], self.left[c] = goal, (a, k)
            users[goal] += 1
            state = self.target[a]
            if users[state] > 1:
                users[state] -= 1
                self.parent.append((state, k))
                state = self.target[a] = len(self.parent) - 1
                users[state] = 1
            self.lost[state, b] = k
        self.memo.clear()
        self.tokens = {labels[t]: t for t in self.target}
        #: Labels as a trie: a node holds its nodes by byte, and at -1 the longest label on the way to it.
        self.root: dict = {-1: -1}
        for label, t in sorted(self.tokens.items()):
            node = self.root
            for byte in label:
                node = node.setdefault(byte, {-1: node[-1]})
            node[-1] = t
        most = max(self.target, default=-1) + 1
        self.size = [len(labels.get(t, b"")) for t in range(most)]
        #: The longest shorter label that each label begins with, or -1.
        self.shorter = [-1] * most
        for label, t in self.tokens.items():
            self.shorter[t] = next((s for i in range(len(label) - 1, 0, -1) if (s := self.tokens.get(label[:i], -1)) >= 0), -1)
        self.longest = max(self.size, default=0)
        self.words = Memo(self)
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def step(self, last: int, label: int, now: int = NEVER - 1) -> bool:
        """Whether the state that arcs ``last`` lead to has an arc ``label``, before merge ``now``."""
        known = self.memo.get(last << 20 | label)
        if known is not None:
            return known
        state, before, out = self.target[last], now, True
        while state >= 0 and out:
            part, made = label, before
            while True:
                if self.lost.get((state, part), NEVER) <= made:  # a merge of a label with itself takes its own new arc, too
                    out = False
                    break
                if part not in self.left:
                    break
                part, k = self.left[part]
                made = min(made, k)
            state, k = self.parent[state]
            before = min(before, k)
        self.memo[last << 20 | label] = out
        if len(self.memo) > MEMO_STEPS:
            self.memo.clear()
        return out

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Ids along the accepting path of one word, longer arcs tried first.

        Each position is reached by one arc only, so a position from which nothing leads on is never tried again.
        """
        whole = self.tokens.get(word)
        if whole is not None:
            return (whole,)
        n, root, size, shorter, memo, longest = len(word), self.root, self.size, self.shorter, self.memo, self.longest
        out: list[int] = []
        dead = set()
        at, label = 0, -1
        while at < n:
            if label < 0:
                node = root
                for byte in word[at : at + longest]:
                    after = node.get(byte)
                    if after is None:
                        break
                    node = after
                label = node[-1]
            while label >= 0:
                if (after := at + size[label]) not in dead:
                    if not out:
                        break
                    ok = memo.get(out[-1] << 20 | label)
                    if self.step(out[-1], label) if ok is None else ok:
                        break
                label = shorter[label]
            if label >= 0:
                out.append(label)
                at, label = after, -1
            else:
                dead.add(at)
                label = out.pop()
                at -= size[label]
                label = shorter[label]
                while label < 0:
                    dead.add(at)
                    label = out.pop()
                    at -= size[label]
                    label = shorter[label]
        return tuple(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            out.extend(map(self.words.__getitem__, self.split.findall(text[at : m.start()])))
            out.append(pack([self.specials[m[0]]]))
            at = m.end()
        out.extend(map(self.words.__getitem__, self.split.findall(text[at:] if at else text)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, unpack(ids))).decode("utf-8", "replace")


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def compile_automaton(vocabulary: str) -> Automaton:
    """From the JSON text of a byte-level vocabulary with its merges."""
    spec = json.loads(vocabulary)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    labels = {t: bytes(letters[x] for x in s) for s, t in vocab.items() if all(x in letters for x in s)}
    specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    automaton = Automaton({t: b for t, b in labels.items() if t not in specials.values()}, merges, specials)
    automaton.labels |= {t: s.encode() for s, t in specials.items()}
    return automaton


_COMPILED: dict[int, Automaton] = {}


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded text of every whole text.

    The vocabulary (a file of a few MB, whatever the input) is broadcast and compiled once a worker.
    """
    spark = docs.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        vocabulary = shipped.value
        key = hash(vocabulary)
        if key not in _COMPILED:
            _COMPILED[key] = compile_automaton(vocabulary)
        automaton = _COMPILED[key]
        for batch in slices(batches):
            ids = [automaton.encode(t or "") for t in batch.column("text").to_pylist()]
            texts = [automaton.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
