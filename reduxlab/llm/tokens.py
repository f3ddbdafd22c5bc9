"""Token ids of whole texts by a public tokenizer, a word at a time.

The tokenizer drops white space and never joins across it, so every run of bytes between ASCII white space is
encoded once and its ids are kept for the task, in two generations of bounded size: when the young one is full it
becomes the old one, and words met again move back. Punctuation at the end of a word is a token of its own, so it is
cut off words that are not known. Plain words are merged together in padded matrices; all others go through the
tokenizer.
"""

import json
import os
import sys
import types

import numpy as np

from .byte_bpe import LONG, MATRIX_VALUES, PairTable, byte_of_sign, merge_matrix

#: Bytes of one generation of known words, with about what Python needs for an entry.
CACHE_BYTES = 40 << 20
ENTRY_BYTES = 200
#: Bytes of a text that are split into words at a time.
PIECE_BYTES = 1 << 20
#: Fixed value: how such a tokenizer cuts the words that are merged here.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_TAIL = b".,;:!?)"
_MARK = "\x00"


def _worker_state(name):
    """A dict that lives as long as the worker process and serves all its tasks."""
    module = sys.modules.setdefault("_reduxlab_worker", types.ModuleType("_reduxlab_worker"))
    return module.__dict__.setdefault(name, {})


def _pieces(raw):
    begin = 0
    while len(raw) - begin > PIECE_BYTES:
        end = max(raw.rfind(space, begin, begin + PIECE_BYTES) for space in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end <= begin:
            following = [raw.find(space, begin + PIECE_BYTES) for space in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")]
            end = min((at for at in following if at >= 0), default=len(raw))
        yield raw[begin:end]
        begin = end
    yield raw[begin:]


class PlainWords:
    """Merges of words that are one piece for sure: letters below U+0250, which have one lower case and no marks."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, suffix = made["model"], made["model"].get("end_of_word_suffix")
        normal = [part["type"] for part in (made.get("normalizer") or {}).get("normalizers", [])]
        cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.usable = (
            bool(suffix)
            and model["type"] == "BPE"
            and not model.get("ignore_merges")
            and normal == ["NFC", "Replace", "Lowercase"]
            and [part.get("type") for part in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": WORD_PATTERN}
            and cuts[0]["invert"]
        )
        if not self.usable:
            return
        ids = model["vocab"]
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.table = PairTable(*(np.array(column) for column in zip(*((ids[a], ids[b], r) for r, (a, b) in enumerate(merges)))))
        self.id_of_rank = np.array([ids[a + b] for a, b in merges], dtype=np.int32)
        sign_of = {b: sign for sign, b in byte_of_sign().items()}
        self.inner = np.array([ids[sign_of[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([ids[sign_of[b] + suffix] for b in range(256)], dtype=np.int32)

    def lowered(self, word):
        """The bytes to merge, or None for a word that the tokenizer must see."""
        if len(word) > LONG or not self.usable:
            return None
        if word.isalpha():
            return word.lower()
        text = word.decode()
        if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
            return text.lower().encode()
        return None

    def encode(self, words):
        """Id bytes of each lowered word, in buckets of doubling length."""
        out, buckets = [b""] * len(words), {}
        for i, word in enumerate(words):
            buckets.setdefault((len(word) - 1).bit_length(), []).append(i)
        for bits, members in buckets.items():
            for begin in range(0, len(members), max(1, MATRIX_VALUES >> bits)):
                part = members[begin : begin + max(1, MATRIX_VALUES >> bits)]
                lengths = np.array([len(words[i]) for i in part])
                matrix = np.full((len(part), int(lengths.max())), -1, dtype=np.int32)
                data = np.frombuffer(b"".join(words[i] for i in part), dtype=np.uint8)
                ids = self.inner[data]
                ids[np.cumsum(lengths) - 1] = self.last[data[np.cumsum(lengths) - 1]]
                matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = ids
                done = merge_matrix(self, matrix)
                used = done >= 0
                data = done[used].astype("<u4").tobytes()
                ends = (4 * np.cumsum(used.sum(axis=1))).tolist()
                for i, a, b in zip(part, [0, *ends], ends):
                    out[i] = data[a:b]
        return out


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, for one task. The worker process keeps the tokenizer only."""

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        state = _worker_state(path)
        if not state:
            from tokenizers import Tokenizer

            state["plain"] = PlainWords(path)
            state["tokenizer"] = Tokenizer.from_file(path)
        self.tokenizer, self.plain = state["tokenizer"], state["plain"]
        self.words, self.old, self.bytes = {}, {}, 0
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _keep(self, word, ids):
        self.words[word] = ids
        self.bytes += len(word) + len(ids) + ENTRY_BYTES

    def _learn(self, words):
        """Keeps the ids of all these words among the young ones."""
        missing, tails, old = [], [], self.old
        for word in words.difference(self.words):
            if word in old:
                self._keep(word, old[word])
                continue
            core = word.rstrip(_TAIL)
            if core and len(core) < len(word) and core[-1:].isalnum() and self.plain.usable:
                tails.append((word, core, word[len(core) :]))
            else:
                missing.append(word)
        if tails:
            self._learn({part for tail in tails for part in tail[1:]})
            for word, core, tail in tails:
                self._keep(word, self.words[core] + self.words[tail])
            missing = [word for word in missing if word not in self.words]
        others, plain, lowered = [], [], []
        for word in missing:
            low = self.plain.lowered(word)
            if low is None:
                others.append(word)
            else:
                plain.append(word)
                lowered.append(low)
        for word, ids in zip(plain, self.plain.encode(lowered) if plain else ()):
            self._keep(word, ids)
        self._by_tokenizer(others)

    def _by_tokenizer(self, words):
        joinable = [w for w in words if _MARK.encode() not in w] if self.mark is not None else []
        for at in range(0, len(joinable), 4096):
            part = joinable[at : at + 4096]
            joined = f" {_MARK} ".join(w.decode() for w in part)
            ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, dtype="<u4")
            cuts = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            data = ids.tobytes()
            if len(cuts) != len(part) + 1:
                self._one_by_one(part)
                continue
            for word, a, b in zip(part, cuts[:-1], cuts[1:]):
                self._keep(word, data[4 * (a + 1) : 4 * b])
        if len(joinable) < len(words):
            self._one_by_one(set(words).difference(joinable))

    def _one_by_one(self, words):
        for word in words:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            self._keep(word, np.array(ids, dtype="<u4").tobytes())

    def encode(self, texts):
        """The id bytes of each text; null counts as empty. Words new to the worker are learnt a batch at a time."""
        pending, size = [], 0
        for text in texts:
            raw = text.encode() if text else b""
            if len(raw) > PIECE_BYTES:
                yield from self._flush(pending)
                pending, size = [], 0
                yield b"".join(ids for piece in _pieces(raw) for ids in self._flush([piece.split()]))
                continue
            pending.append(raw.split())
            size += len(raw)
            if size > PIECE_BYTES:
                yield from self._flush(pending)
                pending, size = [], 0
        yield from self._flush(pending)

    def _flush(self, pending):
        if self.bytes > CACHE_BYTES:
            self.words, self.old, self.bytes = {}, self.words, 0
        self._learn(set().union(*pending) if pending else set())
        get = self.words.__getitem__
        return [b"".join(map(get, row)) for row in pending]
