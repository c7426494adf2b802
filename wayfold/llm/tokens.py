"""Token ids of whole texts, for use inside tasks.

Texts are cut at blanks, which no token of the tokenizers in use crosses (a token may begin with one). Each distinct part of a block of texts goes
through the tokenizer once, many parts as one text; where the ids of a part end follows from the bytes that each id stands
for. Splitting, counting and gathering are array operations. A text whose white space is of another kind is encoded as it is.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks the first part of a text, which has no blank before it.
_FIRST = "\x01"
# White space (or our mark) that libraries do not treat alike, and the bytes without which a block of texts has none of it.
_ODD = r"[\x01\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD_BYTES = np.zeros(256, bool)
_ODD_BYTES[[0x01, 0x0B, 0x0C, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
# Runs of white space in which a blank may be a token's beginning or not, by what follows.
_RUNS = r"[ \n\r\t][ \r\t]| [\n\r\t]|[\r\t]| $"
_EDGE = re.compile(r"[a-z](?= [a-z])")

#: Bytes of text that are worked on at a time. A larger block meets more parts again and takes more memory, about six times its size.
BLOCK = 32 << 20
CALL = 1 << 12  # characters that go through the tokenizer at a time, and the least length of a long odd text's pieces
GATHER = 1 << 18  # parts whose ids are gathered at a time
END_OF_WORD = "</w>"


def _pieces(text: str) -> Iterator[str]:
    """`text` in pieces of about CALL characters, cut where a plain word ends and a blank and another one follow."""
    at = 0
    while len(text) - at > CALL:
        edge = _EDGE.search(text, at + CALL)
        if edge is None:
            break
        yield text[at : edge.end()]
        at = edge.end()
    yield text[at:]


class Encoder:
    def __init__(self, path: str, block: int | None = None):
        self.block = block or BLOCK
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes that each id stands for; byte-level vocabularies have one character for each.
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes[number] = len(token.removesuffix(END_OF_WORD))
        self.drops_space = self._plain("a \n b") == self._plain("a") + self._plain("b")

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of `texts` and how many each has, one by one."""
        ids, sizes = [np.empty(0, np.uint32)], np.zeros(len(texts), np.int64)
        for at, text in enumerate(texts):
            for piece in _pieces(text):
                found = self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids
                ids.append(np.array(found, np.uint32))
                sizes[at] += len(found)
        return np.concatenate(ids), sizes

    def _joined(self, parts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ` part` for each of `parts` (of `sizes` bytes) and how many each has, by encoding all as one text."""
        text = " " + " ".join(parts)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        if not self.drops_space:
            sizes = sizes + 1
        elif not text.isascii():  # sizes in the form the tokenizer works on; if its form is another, the check below fails
            normal = unicodedata.normalize("NFC", text).lower().encode().split(b" ")
            sizes = np.fromiter(map(len, normal[1:]), np.int64, len(normal) - 1)
        ends, want = np.cumsum(self.bytes[ids]), np.cumsum(sizes)
        if len(sizes) == len(parts) and len(ids) and ends[-1] == want[-1]:
            last = np.searchsorted(ends, want, side="right")
            if (np.concatenate([[0], ends])[last] == want).all():
                return ids, np.diff(last, prepend=0)
        return self._each([" " + p for p in parts])

    def _distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct `parts`, where each part's begin, and how many it has."""
        sizes = pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        plain = pc.string_is_ascii(parts).to_numpy(zero_copy_only=False)
        alone = pc.starts_with(parts, _FIRST).to_numpy(zero_copy_only=False) | (sizes == 0)
        # ASCII parts together, others together, and what begins a text (or is nothing) by itself.
        order = np.concatenate([np.flatnonzero(plain & ~alone), np.flatnonzero(~plain & ~alone), np.flatnonzero(alone)])
        texts, sizes = parts.take(pa.array(order)).to_pylist(), sizes[order]
        together = len(order) - int(alone.sum())
        edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes[:together] + 1) // CALL)) + 1, [together]]))
        found = [self._joined(texts[a:b], sizes[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        found.append(self._each([t.removeprefix(_FIRST) for t in texts[together:]]))
        counts = np.concatenate([f[1] for f in found])
        size, place = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        size[order], place[order] = counts, np.cumsum(counts) - counts
        return np.concatenate([f[0] for f in found]), place, size

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts with plain white space, one after another, and how many each has."""
        if self.drops_space:
            split = pc.ascii_split_whitespace(texts)
        else:
            split = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(_FIRST, pa.large_string()), texts, pa.scalar("", pa.large_string())), " ")
        coded = split.flatten().dictionary_encode()
        ids, place, size = self._distinct(coded.dictionary)
        codes, place, size = coded.indices.to_numpy(zero_copy_only=False), place.astype(np.int32), size.astype(np.int32)
        sizes = size[codes]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        flat = np.empty(int(ends[-1]), np.uint32)
        for a in range(0, len(codes), GATHER):
            part, counts = codes[a : a + GATHER], sizes[a : a + GATHER]
            stops = np.cumsum(counts, dtype=np.int32)
            at = np.repeat(place[part] - stops + counts, counts)
            at += np.arange(len(at), dtype=np.int32)
            flat[ends[a] : ends[a] + len(at)] = ids[at]
        return flat, np.diff(ends[split.offsets.to_numpy() - split.offsets[0].as_py()])

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts have white space, or a special token's text, that wants the tokenizer's own eye."""
        odd = np.zeros(len(texts), bool)
        data = texts.buffers()[2]
        if data is not None and _ODD_BYTES[np.frombuffer(data, np.uint8)].any():
            odd |= pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if not self.drops_space:
            odd |= pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
        for mark in self.special:
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        return odd

    def _block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        odd = self._odd(texts)
        common = texts.filter(pa.array(~odd))
        ids, sizes = self._regular(common) if len(common) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        at, sizes = 0, iter(sizes.tolist())
        strange = iter(texts.filter(pa.array(odd)).to_pylist())
        for is_odd in odd:
            if is_odd:
                text = next(strange)
                # Only plain white space may be cut at; a special token's text may be anywhere.
                yield self._each([text])[0]
            else:
                n = next(sizes)
                yield ids[at : at + n]
                at += n

    def encode(self, texts: pa.Array | Sequence[str | None]) -> Iterator[np.ndarray]:
        """The ids of each whole text in turn; none for a null or empty one."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // self.block
        edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
        for a, b in zip(edges, edges[1:]):
            yield from self._block(pc.fill_null(texts.slice(a, b - a).cast(pa.large_string()), ""))
