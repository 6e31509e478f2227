"""Byte-pair encoding by depth-first traversal of a trie of distinct words.

For a fixed table of merges the last token of a word's encoding is a property of the word alone, and the
tokens before it are the encoding of the rest. So each trie node, which stands for a prefix, needs one
token: the only suffix that is a token and can follow the last token of the prefix before it. A depth-first
walk finds it for every node, once for all words that share the prefix.

Two tokens can stand side by side if replaying their merges never offers a merge across their border that
comes before the border tokens are used up. A depth-first walk holds the states of one path only.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gradeloom.llm.blocks import SpanHasher, WIDE_BYTES, slices, text_bytes

#: The split of byte-level vocabularies, and how they write bytes as letters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Distinct words that a task remembers; beyond it, it starts anew.
REMEMBERED_WORDS = 400_000
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """Byte for each letter of a byte-level vocabulary: printable ones stand for themselves."""
    others = [b for b in range(256) if b not in _PRINTABLE]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteVocabulary:
    """Tokens, merges and special tokens of a byte-level vocabulary file (its JSON text).

    Raises ``ValueError`` for files of another kind: normalisers, unknown tokens, word ends, added prefix
    spaces and specials that strip blanks or ask for whole words are not handled.
    """

    def __init__(self, file: str) -> None:
        spec = json.loads(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not (spec["normalizer"] or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        plain = plain and not (model.get("ignore_merges") or model.get("dropout") or split.get("add_prefix_space"))
        if not plain or model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        self.bytes = {i: bytes(map(letters.__getitem__, t)) for t, i in model["vocab"].items()}
        self.id = {b: i for i, b in self.bytes.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = model["vocab"][left], model["vocab"][right]
            whole = model["vocab"][left + right]
            if whole in self.parts:
                raise ValueError(f"two merges make token {whole}")
            self.rank[a, b], self.parts[whole], self.made[whole] = rank, (a, b), rank
        self.longest = max(map(len, self.id))
        self.special = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"special token {t['content']!r} strips or needs whole words")
            self.special[t["content"]] = t["id"]
            self.bytes[t["id"]] = t["content"].encode()
        self._spines: tuple[dict, dict] = ({}, {})
        self._whole: dict[int, bool] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Tokens at the left (0) or right (1) border while ``token`` is built: (token, made at, used up at)."""
        known = self._spines[side]
        if token not in known:
            out, t, used = [], token, _NEVER
            while t in self.parts:
                out.append((t, self.made[t], used))
                used = self.made[t]
                t = self.parts[t][side]
            out.append((t, -1, used))
            known[token] = out
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges of ``a`` followed by ``b`` leave both as they are."""
        rank = self.rank.get
        for x, x_made, x_used in self.spine(a, 1):
            for y, y_made, y_used in self.spine(b, 0):
                if x_made < y_used and y_made < x_used and (m := rank((x, y), _NEVER)) < x_used and m <= y_used and m < _NEVER:
                    return False
        return True

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token; some can never be reached."""
        if token not in self._whole:
            self._whole[token] = merged(self, self.bytes[token]) == [token]
        return self._whole[token]


def merged(vocabulary: ByteVocabulary, word: bytes) -> list[int]:
    """Encoding by replaying merges, lowest rank and leftmost first; the plain way, quadratic in the word."""
    ids = [vocabulary.id[word[k : k + 1]] for k in range(len(word))]
    while len(ids) > 1:
        best = min(range(len(ids) - 1), key=lambda k: (vocabulary.rank.get((ids[k], ids[k + 1]), _NEVER), k))
        if (ids[best], ids[best + 1]) not in vocabulary.rank:
            break
        ids[best : best + 2] = [vocabulary.id[vocabulary.bytes[ids[best]] + vocabulary.bytes[ids[best + 1]]]]
    return ids


class TrieEncoder:
    """Encodes sets of distinct words. Their trie is walked along the sorted words, of which only one path is held."""

    def __init__(self, vocabulary: ByteVocabulary) -> None:
        self.vocabulary = vocabulary
        self.step: dict[int, int] = {}  # trie of the tokens: state and byte to state
        self.token: list[int] = [-1]  # token that ends in a state
        for token, whole in vocabulary.bytes.items():
            state = 0
            for byte in whole if token not in vocabulary.special.values() else b"":
                state = self.step.setdefault(state << 8 | byte, len(self.token))
                if state == len(self.token):
                    self.token.append(-1)
            self.token[state] = token if state else -1
        self.follows: dict[int, bool] = {}  # whether a token may follow another, or (-1) begin a word

    def may_follow(self, last: int, token: int) -> bool:
        fine = self.vocabulary.whole(token) and (last < 0 or self.vocabulary.fits(last, token))
        self.follows[last * (1 << 32) + token] = fine
        return fine

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Encoding of each word, in the order given."""
        out: list[list[int]] = [[]] * len(words)
        step, token_of, known = self.step.get, self.token, self.follows.get
        last: list[int] = [-1]  # of each prefix on the path, its last token
        before: list[int] = [0]  # the length of the prefix before that token
        begun: list[list[tuple[int, int]]] = [[]]  # where tokens may have begun, and their states, longest first
        path = b""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            path = word
            del last[shared + 1 :], before[shared + 1 :], begun[shared + 1 :]
            here = begun[shared]
            for depth in range(shared, len(word)):
                byte = word[depth]
                here = [(start, after) for start, state in here if (after := step(state << 8 | byte))]
                if after := step(byte):
                    here.append((depth, after))
                chosen, at = -1, 0
                for start, state in here:
                    if (t := token_of[state]) >= 0:
                        left = last[start] if start else -1
                        if (fine := known(left * (1 << 32) + t)) is None:
                            fine = self.may_follow(left, t)
                        if fine:
                            chosen, at = t, start
                            break
                last.append(chosen)
                before.append(at)
                begun.append(here)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at = before[at]
            ids.reverse()
            out[k] = ids
        return out


class PreTokens:
    """Cuts a block of texts into the words of byte-level vocabularies, for all characters at once.

    A run of letters, of digits or of other signs is a word, with the space before it; of a run of blanks
    before a word the last one is cut off; apostrophe endings are words. Equals ``SPLIT`` text by text.
    """

    _CLASSES = (r"\s", r"\p{L}", r"\p{N}")
    _ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

    def __init__(self) -> None:
        self.kind = np.full(0x110000, 255, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other; 255 not yet known
        self.tests = [regex.compile(c) for c in self._CLASSES]

    def classes(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        if (kinds == 255).any():
            for point in np.unique(points[kinds == 255]).tolist():
                self.kind[point] = next((k for k, t in enumerate(self.tests) if t.match(chr(point))), 3)
            kinds = self.kind[points]
        return kinds

    def __call__(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Byte positions at which words start. ``edges`` are the byte positions at which texts start."""
        if len(data) == 0:
            return np.zeros(0, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = _code_points(data, lead)
        n = len(points)
        kinds = self.classes(points)
        first = np.zeros(n + 1, bool)  # characters that start a text
        first[np.searchsorted(lead, edges)] = True
        first[n] = True
        start = first[:n].copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        blank_last = np.zeros(n, bool)  # last blank of a run, with a word behind it
        blank_last[:-1] = (kinds[:-1] == 0) & (kinds[1:] != 0) & ~first[1:n]
        start |= blank_last
        joined = np.flatnonzero(blank_last & (points == 32)) + 1
        start[joined] = False
        ticks = np.flatnonzero((points == 39) & start)
        for ending in self._ENDINGS if len(ticks) else ():
            size = len(ending) + 1
            at = ticks[ticks + size <= n]
            for k, letter in enumerate(ending, 1):
                at = at[(points[at + k] == ord(letter)) & ~first[at + k]]
            start[at + 1] = False
            start[(at + size)[at + size < n]] = True
        return lead[start]


def _code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Code points of the characters that begin at ``lead``, of valid UTF-8."""
    points = data[lead].astype(np.int32)
    for low, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        wide = np.flatnonzero((data[lead] >= low) & (data[lead] < {2: 0xE0, 3: 0xF0, 4: 0x100}[size]))
        value = points[wide] & mask
        for k in range(1, size):
            value = value << 6 | (data[lead[wide] + k] & 0x3F)
        points[wide] = value
    return points


class TextCodec:
    """Encodes and decodes blocks of whole texts."""

    def __init__(self, file: str) -> None:
        self.vocabulary = ByteVocabulary(file)
        self.encoder = TrieEncoder(self.vocabulary)
        self.pre_tokens, self.hasher = PreTokens(), SpanHasher()
        self.known: dict[int, bytes] = {}
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile(b"|".join(regex.escape(s.encode()) for s in special)) if special else None
        tokens = self.vocabulary.bytes
        self.pool = np.frombuffer(b"".join(tokens.values()), np.uint8)
        self.size, self.place = np.zeros(max(tokens) + 1, np.int64), np.zeros(max(tokens) + 1, np.int64)
        sizes = np.array([len(t) for t in tokens.values()])
        self.size[list(tokens)], self.place[list(tokens)] = sizes, np.cumsum(sizes) - sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and the n + 1 positions of its texts among them.

        Special tokens written out in a text are special tokens, within a text, not across two.
        """
        raw, edges, specials = data.tobytes(), offsets, []
        if self.special:
            for m in self.special.finditer(raw):
                if np.searchsorted(offsets, m.start(), "right") == np.searchsorted(offsets, m.end() - 1, "right"):
                    specials.append(m.span())
        if specials:
            edges = np.unique(np.concatenate([offsets, np.array(specials).ravel()]))
        start = self.pre_tokens(data, edges[edges < len(data)])
        if specials:
            cut = np.array(specials)
            inside = np.searchsorted(cut[:, 0], start, "right") - 1
            keep = (inside < 0) | (start >= cut[inside, 1]) | (start == cut[inside, 0])
            start = start[keep]
        end = np.append(start[1:], len(data))
        hashes, sample, which = np.unique(self.hasher(data, start, end), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        words = [raw[a:b] for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist())]
        whole = {s.encode(): i for s, i in self.vocabulary.special.items()} if specials else {}
        for k, word, ids in zip(new, words, self.encoder.encode(words)):
            ids = [whole[word]] if word in whole else ids
            self.known[keys[k]] = struct.pack(f"<{len(ids)}I", *ids)
        found = [self.known[key] for key in keys]
        counts = np.array([len(f) // 4 for f in found], np.int64)
        ids = _gathered(np.frombuffer(b"".join(found), "<u4"), np.cumsum(counts) - counts, counts, which)
        upto = np.concatenate(([0], np.cumsum(counts[which])))
        return ids, upto[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, which may cut a character in two at either end."""
        return _gathered(self.pool, self.place, self.size, ids).tobytes()


def _gathered(pool: np.ndarray, place: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces ``which`` of a pool, end to end."""
    sizes = size[which]
    total = np.cumsum(sizes)
    shift = np.repeat(place[which] - (total - sizes), sizes)
    return pool[shift + np.arange(len(shift))]


def encode_texts(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """All columns of ``docs`` and the encoding of ``text``.

    Adds ``n_tokens long, token_ids binary, decoded string, ids_sha256 string, decoded_sha256 string``,
    without ``token_ids`` and ``decoded`` if ``ids`` is false. ``token_ids`` are little-endian unsigned
    32-bit numbers; ``decoded`` is the text decoded from them. An input column of one of these names is
    replaced. Null and empty texts have no tokens and decode to the empty text; repeated rows stay.

    Nothing is shuffled. The vocabulary file is read by the driver and sent to the tasks; its size is that
    of the model. A task holds one block of texts, its trie and ``REMEMBERED_WORDS`` encodings.
    """
    names = ["n_tokens", "token_ids", "decoded", "ids_sha256", "decoded_sha256"]
    if text in names:
        raise ValueError(f"the text column must not be called {text}")
    if not ids:
        names = [n for n in names if n not in ("token_ids", "decoded")]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in names))
    with open(tokenizer_path, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = {"n_tokens": "long", "token_ids": "binary"} | {n: "string" for n in names[-2:]} | {"decoded": "string"}
    schema = docs.select("*").schema
    for n in names:
        schema = schema.add(n, fields[n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TextCodec(file.value)
        for batch in slices(batches, text, WIDE_BYTES):
            data, offsets = text_bytes(batch.column(text))
            numbers, upto = codec.encode(data, offsets)
            encoded = [numbers[a:b] for a, b in zip(upto[:-1], upto[1:])]
            decoded = [codec.decode(e).decode("utf-8", "replace") for e in encoded]
            made = {
                "n_tokens": pa.array(np.diff(upto), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(e.tobytes()).hexdigest() for e in encoded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            }
            if ids:
                made["token_ids"] = pa.array([e.tobytes() for e in encoded], pa.binary())
                made["decoded"] = pa.array(decoded, pa.string())
            columns = batch.columns + [made[n] for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names + names)

    return docs.mapInArrow(run, schema)
