"""Byte-pair encoding and decoding with a public vocabulary file of the tokenizers format.

Each word is encoded by a priority queue of merge ranks over a doubly linked list of symbols: the cheapest pair is
taken, entries whose symbols have changed since are skipped, and the new neighbours' pairs are pushed. Words repeat, so
each worker keeps the ids of words it has seen, up to a fixed number, beyond which it starts afresh. Decoding joins the
vocabulary strings as the file's decoder says (none: a space between strings).

Supported: the normaliser sequence NFC, white-space replacement, lower-casing; a splitting pattern whose matches are
kept; byte-level symbols; an end-of-word suffix; special tokens found in the raw text. A file that asks for something
else is refused with an error.

Letters and numbers come from Python's Unicode tables (15.1); words with letters that Unicode added later may be cut
otherwise than by the tokenizers library.

Defined cases: null counts as empty and gives no ids. Repeated rows are encoded one by one; other columns are kept by
`stage` and not read by `encode`.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from docframe.cluster import ship

#: Bits of an id in the key of a pair, and of a place in an entry of the queue.
PAIR, PLACE = 24, 40
#: Words whose ids a worker keeps at most.
KEPT_WORDS = 400_000
#: White space of the Unicode standard, as the splitting patterns' engine sees it.
WHITE = "[" + "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]"
_NEWER = regex.compile(r"[\p{L}\p{N}]")
_LOADED: dict[str, "Bpe"] = {}


def byte_symbols() -> list[str]:
    """The character that stands for each byte value: itself where printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("this kind of model is not supported")
        if spec.get("decoder") is not None or spec.get("post_processor") is not None:
            raise ValueError("decoders and post-processors are not supported")
        self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a] << PAIR | self.vocab[b]] = (rank, self.vocab[a + b])
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {}
        for t in spec.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("this kind of added token is not supported")
            self.special[t["content"]] = t["id"]
            self.strings[t["id"]] = t["content"]
        parts = [regex.escape(s) for s in sorted(self.special, key=len, reverse=True)]
        self.cut = regex.compile("(" + "|".join(parts) + ")") if parts else None
        self.steps = [self._step(x) for x in (spec["normalizer"]["normalizers"] if spec.get("normalizer") else [])]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError("this pre-tokeniser is not supported")
        pattern = split["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]", "[^" + WHITE[1:-1] + r"\p{L}\p{N}]")
        self.pattern = regex.compile(pattern)
        # Letters and numbers that Python's tables don't know yet are neither for the tokenizers library.
        self.newer = frozenset(c for c in map(chr, range(0x530, 0x110000)) if unicodedata.category(c) == "Cn" and _NEWER.match(c))
        own = "[" + "".join(sorted(self.newer)) + "]"
        pattern = pattern.replace(r"[\p{L}]", rf"[\p{{L}}--{own}]").replace(r"[\p{N}]", rf"[\p{{N}}--{own}]")
        self.strict = regex.compile(pattern.replace("[^" + WHITE[1:-1] + r"\p{L}\p{N}]", "[[^" + WHITE[1:-1] + r"\p{L}\p{N}]||" + own + "]"), regex.V1)
        symbols = byte_symbols()
        self.inner, self.last = [self.vocab.get(c) for c in symbols], [self.vocab.get(c + self.suffix) for c in symbols]
        self.known: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _step(x: dict):
        if x["type"] == "NFC":
            return lambda s: s if s.isascii() else unicodedata.normalize("NFC", s)
        if x["type"] == "Lowercase":
            return lambda s: s.lower() if s.isascii() else "".join([c.lower() for c in s])
        if x["type"] == "Replace" and "Regex" in x["pattern"]:
            pattern = regex.compile(x["pattern"]["Regex"].replace(r"\s", WHITE))
            put = x["content"].replace("\\", "\\\\")  # a template that stands for itself
            return lambda s: pattern.sub(put, s)
        raise ValueError(f"the normaliser {x['type']} is not supported")

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one word of the splitting pattern.

        Symbols are a doubly linked list; the queue holds (rank, place) as one number. An entry is stale unless the pair
        that is now at its place has its rank, as each pair has a rank of its own.
        """
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        if None in ids:
            ids = [x for x in ids if x is not None]
        n, rank_of, pop, push = len(ids), self.ranks.get, heapq.heappop, heapq.heappush
        queue = []
        for i in range(n - 1):
            if found := rank_of(ids[i] << PAIR | ids[i + 1]):
                queue.append(found[0] << PLACE | i)
        if not queue:
            return tuple(ids)
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = pop(queue)
            i = entry & (1 << PLACE) - 1
            j = after[i]
            if j >= n or ids[i] < 0:
                continue
            found = rank_of(ids[i] << PAIR | ids[j])
            if not found or found[0] != entry >> PLACE:
                continue
            ids[i], ids[j] = found[1], -1  # j is gone
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := rank_of(ids[i] << PAIR | ids[k]):
                    push(queue, found[0] << PLACE | i)
            if (k := before[i]) >= 0 and (found := rank_of(ids[k] << PAIR | ids[i])):
                push(queue, found[0] << PLACE | k)
        return tuple([x for x in ids if x >= 0])

    def _plain(self, text: str, out: list[int]) -> None:
        for step in self.steps:
            text = step(text)
        known = self.known
        pattern = self.pattern if text.isascii() or self.newer.isdisjoint(text) else self.strict
        for w in pattern.findall(text):
            if (ids := known.get(w)) is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                ids = self.word(w)
                if len(w) <= 64:
                    known[w] = ids
            out += ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if not self.cut:
            self._plain(text, out)
            return out
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids])


def load(path: str) -> Bpe:
    """The coder of a vocabulary file, once for each worker."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            _LOADED[path] = Bpe(json.load(f))
    return _LOADED[path]


def _texts(batch, column="text"):
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "").to_pylist()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (its columns but text) with ids array<int>; path: a vocabulary file that every executor has."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    out = docs.select("text", *rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[1:])

    def run(batches):
        coder = load(path)
        for batch in batches:
            ids = pa.array([np.array(coder.encode(t), np.int32) for t in _texts(batch)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids], names=[*rest, "ids"])

    return out.mapInArrow(run, f"{schema + ', ' if schema else ''}ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded (its columns but ids) with text: the decoded ids."""
    ship(coded.sparkSession)
    rest = [c for c in coded.columns if c != "ids"]
    out = coded.select("ids", *rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[1:])

    def run(batches):
        coder = load(path)
        for batch in batches:
            texts = [coder.decode(x or ()) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*rest, "text"])

    return out.mapInArrow(run, f"{schema + ', ' if schema else ''}text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: what encode() and decode() give, in one pass."""
    ship(docs.sparkSession)

    def run(batches):
        coder = load(path)
        for batch in batches:
            n, first, second = [], [], []
            for text in _texts(batch):
                ids = coder.encode(text)
                n.append(len(ids))
                first.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                second.append(hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def stage(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens, ids and decoded after its own columns (an own column of such a name is replaced)."""
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded")]
    out = docs.select(*own)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)

    def run(batches):
        coder = load(path)
        for batch in batches:
            ids = [coder.encode(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(x) for x in ids], pa.int64()), pa.array([np.array(x, np.int32) for x in ids], pa.list_(pa.int32())), pa.array([coder.decode(x) for x in ids], pa.string())],
                names=[*own, "n_tokens", "ids", "decoded"],
            )

    return out.mapInArrow(run, f"{fields}, n_tokens long, ids array<int>, decoded string")
