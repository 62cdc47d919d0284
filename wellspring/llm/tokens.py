"""Token ids of texts by a public byte-level vocabulary."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
BLOCK_CHARS = 65_536
GROUP_CHARS = 2_097_152
PLAIN_GAPS = " \t\n\r\x0b\x0c"
_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to those of the vocabulary's ``tokenizers`` file.

    The vocabulary splits a text before it merges: a space that follows a visible character begins a new piece, so
    the ids of a text are those of its pieces cut there, one after another. The pieces of some texts are told apart
    in Arrow and each different one is encoded once, all in one call by the same vocabulary's ranks; the bytes that
    each id stands for tell where the ids of a piece end. Texts whose spaces do not stand between visible
    characters are encoded whole, and one with a special token's string goes to the full pipeline, which is loaded
    when one comes. Longer texts are cut in the same places into blocks, so that only ``GROUP_CHARS`` and a block
    are held as pieces.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.vocabulary = vocabulary
        with open(vocabulary, encoding="utf-8") as described:
            self.special = [token["content"] for token in json.load(described)["added_tokens"]]
        self.id_bytes = np.zeros(max(table.values()) + 1, "i8")
        self.id_bytes[list(table.values())] = [len(piece) for piece in table]

    @cached_property
    def full(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.ranks.encode_ordinary(text), "<u4")

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text in turn."""
        held, size, done = [], 0, []
        for text in texts:
            for block, is_last in _with_last([text] if self._is_special(text) else _blocks(text)):
                held.append((block, is_last))
                size += len(block)
                if size >= GROUP_CHARS:
                    yield from self._finish(held, done)
                    held, size = [], 0
        yield from self._finish(held, done)

    def _is_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def _finish(self, held: list[tuple[str, bool]], done: list[bytes]) -> Iterator[bytes]:
        """Ids of the texts that end in these blocks; ``done`` holds those of the blocks before of an open text."""
        for ids, (_, is_last) in zip(self._encode_blocks([block for block, _ in held]), held):
            done.append(ids)
            if is_last:
                yield b"".join(done)
                done.clear()

    def _encode_blocks(self, blocks: list[str]) -> Iterator[bytes]:
        """A block is its first word, the words behind a space each, and the gap at its end."""
        parts, rests = [], []
        for block in blocks:
            if self._is_special(block):
                parts.append((np.array(self.full.encode(block, add_special_tokens=False).ids, "<u4"), False, ""))
                continue
            body = block.rstrip(PLAIN_GAPS)
            if body[-1:].isspace() or _ODD.search(body):
                parts.append((self.plain(block), False, ""))
                continue
            first, space, rest = body.partition(" ")
            parts.append((self.plain(first), bool(space), block[len(body):]))
            if space:
                rests.append(rest)
        ids = self._encode_words(rests) if rests else iter(())
        for head, more, gap in parts:
            yield b"".join((head.tobytes(), next(ids).tobytes() if more else b"", self.plain(gap).tobytes() if gap else b""))

    def _encode_words(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text with a space before it; all spaces stand between visible characters."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = lists.flatten().dictionary_encode()
        each, which = words.dictionary, words.indices.to_numpy()
        whole = pa.LargeListArray.from_arrays(pa.array([0, len(each)], pa.int64()), each)
        ids = self.plain(" " + pc.binary_join(whole, pa.scalar(" ", pa.large_string()))[0].as_py())
        ends = np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum(pc.binary_length(each).to_numpy() + 1)) + 1
        sizes = np.diff(ends, prepend=0)
        taken = sizes[which]
        upto = np.concatenate([[0], np.cumsum(taken)])
        found = ids[np.repeat((ends - sizes)[which] - upto[:-1], taken) + np.arange(upto[-1])]
        cuts = upto[lists.offsets.to_numpy()]
        return (found[a:b] for a, b in zip(cuts[:-1], cuts[1:]))


def _blocks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > BLOCK_CHARS and (cut := _CUT.search(text, at + BLOCK_CHARS)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def _with_last(items: Iterable[str]) -> Iterator[tuple[str, bool]]:
    items = iter(items)
    held = next(items)
    for item in items:
        yield held, False
        held = item
    yield held, True


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    """The encoder of this process. Without paths, those of the installed public vocabulary of 50,257 ids."""
    if vocabulary is None or ranks is None:
        import public_tokenizers

        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if (vocabulary, ranks) not in _encoders:
        _encoders[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return _encoders[vocabulary, ranks]


def token_bytes(texts: Iterable[str | None], vocabulary: str | None = None, ranks: str | None = None, end_id: int = END_ID) -> Iterator[bytes]:
    """Ids of each text (null: empty) and the end id."""
    end = np.array([end_id], "<u4").tobytes()
    for ids in encoder(vocabulary, ranks).encode_all(text or "" for text in texts):
        yield ids + end
