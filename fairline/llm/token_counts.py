"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import regex
import pyarrow as pa
from pyspark.sql import DataFrame

from fairline.llm.text import (CHUNK, KEY, ODD_SPACE, STABLE, TEXT, Memo, byte_letters, key_type, keyed,
                               map_batches, once, read_source, slices, specials, tokenizer)

#: The pre-token pattern of byte-level vocabularies (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def whole_tokens(source: str) -> frozenset[str]:
    """The vocabulary strings that the tokenizer encodes, alone, as exactly one token.

    That is the proof the shortcut needs: merges never leave a pre-token, so wherever such a string
    is a pre-token it costs one token, and no merging has to be run to know it.
    """
    tok = tokenizer(source)
    back = {letter: b for b, letter in byte_letters().items()}
    strings = []
    for token in tok.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(back[c] for c in token).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a pre-token of a text
    found = tok.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, found, strict=True) if len(e) == 1)


class Counter:
    """Counts tokens of texts; chunks seen before are looked up."""

    def __init__(self, source: str, whole: frozenset[str]):
        self.tok, self.whole = tokenizer(source), whole
        self.special = specials(self.tok)
        self.pattern = regex.compile(PRE_TOKENS)
        self.memo = Memo(self.learn)

    def learn(self, chunks: list[str]) -> dict[str, int]:
        found, rest = {}, {}
        for chunk in chunks:
            if chunk in self.whole:
                found[chunk] = 1
            elif STABLE.search(chunk):
                rest.setdefault(chunk, []).append(chunk)
                found[chunk] = 0
            else:
                direct = 0
                for piece in self.pattern.findall(chunk):
                    if piece in self.whole:
                        direct += 1
                    else:
                        rest.setdefault(piece, []).append(chunk)
                found[chunk] = direct
        pieces = list(rest)
        for piece, e in zip(pieces, self.tok.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            for chunk in rest[piece]:
                found[chunk] += len(e)
        return found

    def plain(self, text: str) -> bool:
        return not ODD_SPACE.search(text) and not any(s in text for s in self.special)

    def counts(self, texts: list[str]) -> list[int]:
        lists = [CHUNK.findall(t) if self.plain(t) else None for t in texts]
        known = self.memo.of([x for x in lists if x])
        get = known.__getitem__
        return [len(self.tok.encode(t, add_special_tokens=False)) if x is None else sum(map(get, x))
                for t, x in zip(texts, lists, strict=True)]


def count_tokens(rows: DataFrame, vocabulary: str, key: str = KEY, text: str = TEXT) -> DataFrame:
    """Tokens of every whole text: (key, ``n_bytes`` UTF-8 bytes, ``n_tokens``), a row per row.

    General: the reference has no prose records, so ``rows`` is any frame with a key and a text.
    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library.  Counts equal the
    library's without begin, end or other added tokens; special strings inside a text count as the
    library's default has it.  Null and empty texts count 0 bytes and 0 tokens; repeated rows each give
    a row, null keys stay null, other columns are ignored, an empty frame gives an empty frame.

    The shortcut: strings proved offline to be single tokens are counted by look-up, and only the
    other pre-tokens are merged. No shuffle; a task holds one slice of texts and a bounded memo.
    """
    source = read_source(vocabulary)
    shared = rows.sparkSession.sparkContext.broadcast((source, whole_tokens(source)))

    def step(batches):
        counter = once("count", shared.value[0], lambda: Counter(*shared.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [n for a, b in slices(texts) for n in counter.counts(texts[a:b])]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=[key, "n_bytes", "n_tokens"])

    return map_batches(keyed(rows, key, text), step, f"`{key}` {key_type(rows, key)}, n_bytes bigint, n_tokens bigint")
