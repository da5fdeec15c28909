"""Operator 9: BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in rank order, into a deterministic automaton over *tokens*: it starts as
one state with a loop per byte, and each merge (u, v) applies one gadget:

- every arc labelled ``u`` is led to a copy of its target state that has no ``v`` arc
  (after ``u`` a plain ``v`` can no longer follow);
- every state with a ``u`` arc gets an arc labelled ``uv`` to where ``v`` led.

All arcs with the same label lead to the same state, so a merge adds at most one state and a state is
"its parent, less one label, since step k".  ``Automaton`` keeps exactly that: ``parent``,
``removed``, ``since`` per state and ``target`` per label.  A merge whose parts can never be
neighbours (``v`` already removed behind ``u``) has no effect.  Every byte string spells exactly one
accepted path, and its labels are the BPE tokens.

``Encoder`` walks byte strings by table: the spelling trie of the labels is composed with the
automaton and made deterministic on demand (a state is the set of open arcs and the last label
emitted; one table entry per state and byte).  Per byte there is one table lookup; the labels are
read off backwards.  The table is a cache of bounded size that is refilled when full, so memory is
bounded and results do not depend on it.  Decoding emits arc labels.

Rows: null text is the empty text and has no tokens; repeated rows are encoded each for itself; an empty
table gives an empty result; columns other than the id and the text are not read.  A text of any length is
encoded whole: the pre-split pattern cuts it to words and each word costs time in proportion to its length.
"""

from __future__ import annotations

import json
from array import array
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepulse.llm.chunks import Remembered, byte_letters, library
from linepulse.llm.common import give_back, in_pandas, per_worker, tokenizer_file, whole_text

MAX_TABLE = 400_000     # entries of the transition table before it is dropped and refilled
MAX_WORDS = 120_000     # remembered words a generation


class Automaton:
    """Merge-gadget automaton over token labels (ids)."""

    def __init__(self, byte_ids: list[int], merges: list[tuple[int, int, int]], n_ids: int):
        """byte_ids: label of each byte; merges: (u, v, label of uv) in rank order."""
        self.byte_ids = byte_ids
        self.n_ids = n_ids
        self.left = [-1] * n_ids       # label uv: u
        self.right = [-1] * n_ids      # label uv: v
        self.born = [-1] * n_ids       # step that made the label; bytes 0; -1: no arc has it
        for b in byte_ids:
            self.born[b] = 0
        self.parent, self.removed, self.since = [-1], [-1], [0]   # state 0: everything may follow
        self.target = [0] * n_ids      # state behind a label
        self._behind: list[dict[int, int] | None] = [None] * n_ids  # removed label -> step, of the label's own states
        for step, (u, v, uv) in enumerate(merges, 1):
            self._gadget(step, u, v, uv)

    def _gadget(self, step: int, u: int, v: int, uv: int) -> None:
        if self.born[u] < 0 or self.born[v] < 0 or not self._follows(u, v):
            return
        if self.born[uv] >= 0:
            raise ValueError(f"label {uv} is made by two merges")
        self.target[uv] = self.target[v]
        self.parent.append(self.target[u])
        self.removed.append(v)
        self.since.append(step)
        self.target[u] = len(self.parent) - 1
        if self._behind[u] is None:
            self._behind[u] = {}
        self._behind[u][v] = step
        self.left[uv], self.right[uv], self.born[uv] = u, v, step

    def _follows(self, x: int, z: int) -> bool:
        """Has the state behind label x an arc labelled z?  (Its own states, then those that it copied.)"""
        last = 1 << 60
        while x >= 0:
            gone = self._behind[x]
            if gone is not None:
                y, until = z, 1 << 60
                while y >= 0:
                    k = gone.get(y)
                    # taken away before the arc that is built on it was added (the gadget of a pair of equal
                    # labels takes away first), and while this state was still x's
                    if k is not None and k <= until and k < last:
                        return False
                    y, until = self.left[y], self.born[y]
            last = self.born[x]
            x = self.right[x]
        return True

    def follows(self, x: int, z: int) -> bool:
        """May label z follow label x (x = -1: at the start)?"""
        return x < 0 or self._follows(x, z)


class Encoder:
    """Table-driven encoding of byte strings with a lazily determinised transition table."""

    def __init__(self, automaton: Automaton, labels: list[bytes], max_table: int = MAX_TABLE):
        self.a = automaton
        self.max_table = max_table
        self.size = [len(x) for x in labels]
        self.child: dict[int, int] = {}
        self.label_at: list[int] = [-1]
        for i, text in enumerate(labels):
            if automaton.born[i] < 0:
                continue
            node = 0
            for b in text:
                key = node << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.label_at)
                    self.label_at.append(-1)
                node = nxt
            self.label_at[node] = i
        self.inner = [False] * len(self.label_at)   # has the node a child?  Else no arc goes on from it.
        for key in self.child:
            self.inner[key >> 8] = True
        self._reset()

    def _reset(self) -> None:
        self.table: dict[int, int] = {}
        self.state_of: dict[tuple, int] = {}
        # per state: the label that ends here, then its open arcs (trie node << 24 | label before the arc + 1)
        self.open: list[tuple] = [(-1, 0)]

    def _step(self, state: int, byte: int) -> int:
        child, label_at, inner, follows = self.child, self.label_at, self.inner, self.a.follows
        key, last = [-1], -1
        for arc in self.open[state][1:]:
            before = arc & 0xFFFFFF
            c = child.get(arc >> 16 & ~0xFF | byte)
            if c is None:
                continue
            z = label_at[c]
            if z >= 0 and last < 0 and follows(before - 1, z):
                last = z
            if inner[c]:
                key.append(c << 24 | before)
        if last < 0:
            raise ValueError("no accepted path")
        key[0] = last
        key.append(last + 1)                    # a new arc begins at the trie's root
        key = tuple(key)
        nxt = self.state_of.get(key)
        if nxt is None:
            nxt = self.state_of[key] = len(self.open)
            self.open.append(key)
        self.table[state << 8 | byte] = nxt
        return nxt

    def encode(self, word: bytes) -> list[int]:
        if len(self.table) > self.max_table:
            self._reset()
        table, states, size = self.table, self.open, self.size
        s, path = 0, []
        for b in word:
            n = table.get(s << 8 | b)
            s = self._step(s, b) if n is None else n
            path.append(s)
        out, i = [], len(word)
        while i:
            z = states[path[i - 1]][0]
            out.append(z)
            i -= size[z]
        out.reverse()
        return out


class ByteBPE:
    """A byte-level BPE tokenizer file: special strings, labels, and for encoding (built when first needed) pattern and automaton."""

    def __init__(self, path: str):
        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._vocab, self._merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*self._vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * n
        for word, i in self._vocab.items():
            self.labels[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.labels[i] = word.encode()
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self._marks = tuple(self.special)
        self._known = Remembered(lambda w: array("I", self.encoder.encode(w.encode("utf-8", "replace"))).tobytes(), MAX_WORDS)

    @cached_property
    def automaton(self) -> Automaton:
        vocab = self._vocab
        pairs = [m if isinstance(m, list) else m.split(" ") for m in self._merges]
        byte_ids = [0] * 256
        for c, b in byte_letters().items():
            byte_ids[b] = vocab[c]
        merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]
        self._vocab = self._merges = None       # not needed any more
        return Automaton(byte_ids, merges, len(self.labels))

    @cached_property
    def encoder(self) -> Encoder:
        special = set(self.special.values())
        made = Encoder(self.automaton, [b"" if i in special else x for i, x in enumerate(self.labels)])
        give_back()
        return made

    @cached_property
    def _strange(self) -> frozenset[str]:
        return strange_letters(self.path)

    @cached_property
    def _fast(self):
        import public_tokenizers
        import regex
        return regex.compile(public_tokenizers.PATTERN).findall

    @cached_property
    def _slow(self):
        import public_tokenizers
        import regex
        return regex.compile(without(public_tokenizers.PATTERN, self._strange)).findall

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as unsigned 32-bit integers; special strings inside it become their own id."""
        if not any(m in text for m in self._marks):
            return self._plain(text)
        return b"".join([array("I", [self.special[x]]).tobytes() if i % 2 else self._plain(x) for i, x in enumerate(self._cut(text))])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._known.__getitem__, self.words(text)))

    def words(self, text: str) -> list[str]:
        """The pre-split words."""
        return (self._fast if text.isascii() or self._strange.isdisjoint(text) else self._slow)(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, array("I", ids))).decode("utf-8", "replace")


def strange_letters(path: str) -> frozenset[str]:
    """Code points that Python's pattern module takes for letters or numbers and the library does not.

    The two may follow different versions of Unicode.
    """
    import regex
    splitter, strange = library.__wrapped__(path).pre_tokenizer, set()      # used once, not kept
    for at in range(0x80, 0x110000, 4096):      # in blocks, so that little memory is held
        block = "".join([chr(c) for c in range(at, min(at + 4096, 0x110000)) if not 0xD800 <= c < 0xE000])
        for kind, lead in ((r"\p{L}", "a"), (r"\p{N}", "1")):
            if found := regex.findall(kind, block):
                ends = {end for _, (_, end) in splitter.pre_tokenize_str(" ".join([lead + c for c in found]))}
                strange.update(c for i, c in enumerate(found) if 3 * i + 1 in ends)   # cut between the lead and c
    return frozenset(strange)


def without(pattern: str, strange: frozenset[str]) -> str:
    """The pre-split pattern with ``strange`` as neither letters nor numbers."""
    import regex
    if not strange:
        return pattern
    odd = "[" + "".join(map(regex.escape, sorted(strange))) + "]"
    return "(?V1)" + (pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{odd}]")
                      .replace(r" ?\p{L}", rf" ?[\p{{L}}--{odd}]").replace(r" ?\p{N}", rf" ?[\p{{N}}--{odd}]"))


@per_worker
def load(path: str) -> ByteBPE:
    """One compiled tokenizer per worker process."""
    return ByteBPE(path)


def encode_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens of every whole text."""
    def run(batches):
        import pandas as pd
        bpe = load(tokenizer_file(tokenizer))
        for pdf in batches:
            ids = [bpe.encode(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "n_tokens": [len(x) // 4 for x in ids]})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return in_pandas(src, run, "doc_id long, ids binary, n_tokens long", ("bpe_automaton", "chunks"))


def decode_documents(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``encoded`` with the decoded text beside the ids."""
    def run(batches):
        bpe = load(tokenizer_file(tokenizer))
        for pdf in batches:
            pdf["decoded"] = [bpe.decode(x) for x in pdf["ids"]]
            yield pdf

    return in_pandas(encoded, run, "doc_id long, ids binary, n_tokens long, decoded string", ("bpe_automaton", "chunks"))


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens and the text decoded from the ids, in one pass (one worker a task holds the tables)."""
    def run(batches):
        import pandas as pd
        bpe = load(tokenizer_file(tokenizer))
        for pdf in batches:
            ids = [bpe.encode(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": [bpe.decode(x) for x in ids]})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return in_pandas(src, run, "doc_id long, ids binary, n_tokens long, decoded string", ("bpe_automaton", "chunks"))


def digests(decoded: DataFrame) -> DataFrame:
    """The contract's columns from the real outputs (ids and decoded text)."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
