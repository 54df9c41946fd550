"""BPE encoding and decoding by a depth-first walk over the trie of distinct words."""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from fairline.llm.text import (KEY, STABLE, TEXT, byte_letters, key_type, keyed, map_batches, once,
                               read_source, slices, specials, tokenizer)

END = "</w>"
NEVER = 1 << 60
MEMO_PAIRS = 1_000_000
MEMO_WORDS = 400_000


class Merges:
    """Vocabulary and merge order of one word-end BPE file, asked about pairs of tokens only."""

    def __init__(self, source: str):
        model = json.loads(source)["model"]
        self.ids: dict[str, int] = model["vocab"]
        if model["end_of_word_suffix"] != END or model["unk_token"] or model["continuing_subword_prefix"]:
            raise ValueError("a BPE file with word ends and without unknown tokens is needed")
        self.order = {tuple(pair): n for n, pair in enumerate(model["merges"])}
        self.parts: dict[str, tuple[str, str]] = {}
        for left, right in self.order:
            self.parts.setdefault(left + right, (left, right))
        self.longest = max(len(t.removesuffix(END)) for t in self.ids)
        self.right_edges, self.left_edges, self.fits, self.alone = {}, {}, {}, {}

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The tokens that stand at one edge of ``token`` while it is built, each with the merge that ends it."""
        held = self.right_edges if side else self.left_edges
        if token not in held:
            part = self.parts.get(token)
            held[token] = ([*self.edge(part[side], side)[:-1], (part[side], self.order[part])] if part else []) + [(token, NEVER)]
        return held[token]

    def apart(self, left: str, right: str) -> bool:
        """Whether no merge ever crosses the border between two neighbouring tokens.

        Both sides are replayed in merge order. The pair at the border merges if its turn comes before
        either half is taken by its own side; at equal turns the leftmost pair goes first.
        """
        at = (left, right)
        if at not in self.fits:
            if len(self.fits) > MEMO_PAIRS:
                self.fits.clear()
            x, y = self.edge(left, 1), self.edge(right, 0)
            i = j = 0
            while True:
                (a, a_ends), (b, b_ends) = x[i], y[j]
                turn = self.order.get((a, b), NEVER)
                if turn != NEVER and turn < a_ends and turn <= b_ends:
                    self.fits[at] = False
                    break
                if a_ends == b_ends == NEVER:
                    self.fits[at] = True
                    break
                if a_ends <= b_ends:
                    i += 1
                else:
                    j += 1
        return self.fits[at]

    def stands(self, token: str) -> bool:
        """Whether merging the token's own letters gives the token: its two parts stand and meet whole."""
        if token not in self.alone:
            part = self.parts.get(token)
            self.alone[token] = True if not part else self.stands(part[0]) and self.stands(part[1]) and self.joins(part)
        return self.alone[token]

    def joins(self, part: tuple[str, str]) -> bool:
        x, y = self.edge(part[0], 1), self.edge(part[1], 0)
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = x[i], y[j]
            turn = self.order.get((a, b), NEVER)
            if a_ends == b_ends == NEVER:
                return turn != NEVER
            if turn < a_ends and turn <= b_ends:
                return False
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Token ids of distinct words (byte letters, without the word end).

        The sorted words are the trie laid out in depth-first order: what two neighbours share is
        their common path, and its states are kept. The state of a path is its last token. A token is
        last where it ends the path and its border with the last token of the path before it holds;
        exactly one does, so the states of a path give its whole encoding, and shared paths are
        encoded once.
        """
        found, states, before = {}, [], ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word)) - 1
            while shared < most and before[shared] == word[shared]:
                shared += 1
            # a word's last letter is written with the word end, so its own state isn't part of the path
            del states[shared:]
            for depth in range(len(states) + 1, len(word)):
                states.append(self.last_token(word[:depth], "", states))
            token = self.last_token(word, END, states)
            ids, at = [self.ids[token]], len(word) - len(token) + len(END)
            while at:
                token = states[at - 1]
                ids.append(self.ids[token])
                at -= len(token)
            found[word] = ids[::-1]
            before = word
        return found

    def last_token(self, path: str, end: str, states: list[str]) -> str:
        for start in range(max(0, len(path) - self.longest), len(path)):
            token = path[start:] + end
            if token in self.ids and self.stands(token) and (not start or self.apart(states[start - 1], token)):
                return token
        raise ValueError(f"no token ends {path!r}")


class Words:
    """The pre-tokens of a word-end vocabulary: text in composed form and lower case, parted by the file's pattern.

    For characters below U+0250, whose classes no Unicode version has changed, the pattern is written out for
    the faster pattern library; texts with others are left to the tokenizers library.
    """

    def __init__(self, source: str):
        self.tok = tokenizer(source)
        (split, *_) = [p["pattern"]["Regex"] for p in json.loads(source)["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        kinds = {k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        spaces = r"\t-\r \x85\xa0"
        pattern = split.replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]).replace(r"\s", spaces)
        self.one, self.spaced, self.ends = re.compile(pattern), re.compile(f"({pattern})[{spaces}]*"), "\t\n\v\f\r \x85\xa0"
        self.back = {c: b for b, c in byte_letters().items()}

    def plain(self, text: str) -> str | None:
        """The normalised text, or None if the tokenizers library has to part it."""
        if text.isascii():
            return text.lower()
        # looked at in lower case: some capitals below U+0250 have small letters above
        text = unicodedata.normalize("NFC", text).lower()
        return None if STABLE.search(text) else text

    def of(self, text: str) -> list[str]:
        if (plain := self.plain(text)) is not None:
            return self.one.findall(plain)
        found = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
        return [bytes(map(self.back.__getitem__, w)).decode() for w, _ in found]

    def marked(self, text: str, mark: str) -> str | None:
        """The text's pre-tokens with a mark after each; None as in :meth:`plain`."""
        plain = self.plain(text)
        return None if plain is None else self.spaced.sub(r"\1" + mark, plain.strip(self.ends))


class Codec:
    """Texts to ids and their decoding; words seen before are looked up, new ones go through the trie."""

    def __init__(self, source: str):
        self.tok, self.merges, self.words = tokenizer(source), Merges(source), Words(source)
        self.special, self.letters = specials(self.tok), byte_letters()
        self.names = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, bytes] = {}

    def learn(self, lists: list[list[str]]) -> None:
        words = set().union(*lists)
        new = words.difference(self.ids_of)
        if len(self.ids_of) + len(new) > MEMO_WORDS and self.ids_of:
            self.ids_of, self.text_of, new = {}, {}, words
        spelt = {w if w.isalpha() and w.isascii() else "".join(map(self.letters.__getitem__, w.encode())): w for w in new}
        for s, ids in self.merges.encode_words(list(spelt)).items():
            self.ids_of[spelt[s]] = array("I", ids).tobytes()
            self.text_of[spelt[s]] = self.decode(ids).encode()

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens' strings with a space between; unknown ids are left out."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(little-endian ids, decoded text) of each text; those with special strings are parted by the library."""
        marked = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        lists = [[] if i in marked else self.words.of(t) for i, t in enumerate(texts)]
        gc.disable()  # many small objects without cycles
        self.learn(lists)
        ids_of, text_of = self.ids_of.__getitem__, self.text_of.__getitem__
        out = [(b"".join(map(ids_of, x)), b" ".join(map(text_of, x))) for x in lists]
        gc.enable()
        for i in marked:
            ids = self.tok.encode(texts[i], add_special_tokens=False).ids
            out[i] = (array("I", ids).tobytes(), self.decode(ids).encode())
        return out


def codec(source: str) -> Codec:
    return once("codec", source, lambda: Codec(source))


def encode(rows: DataFrame, vocabulary: str, key: str = KEY, text: str = TEXT, digests: bool = False) -> DataFrame:
    """BPE ids of every whole text and their decoding: (key, ``ids``, ``decoded``), a row per row.

    General: the reference has no prose records, so ``rows`` is any frame with a key and a text.
    ``vocabulary`` is the path of a word-end BPE file of the tokenizers library; ids and decoded text
    equal the library's without added tokens, special strings inside texts being read as special.
    ``digests`` adds n_tokens, and SHA-256 of ids (little-endian unsigned 32-bit) and of decoded text in
    place of the values, so that neither need leave the task.  Null and empty texts give no ids and
    empty text; repeated rows each give a row, null keys stay null, other columns are ignored.

    Merges never leave a pre-token, so a text's encoding is that of its words in turn. The distinct
    new words of a slice of texts go through one trie walk. No shuffle; memory is a slice and a memo.
    """
    shared = rows.sparkSession.sparkContext.broadcast(read_source(vocabulary))
    kind = key_type(rows, key)

    def step(batches):
        made = codec(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pairs = (p for a, b in slices(texts) for p in made.encode(texts[a:b]))
            if digests:
                found = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for i, d in pairs]
                columns = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()),
                           pa.array([x[2] for x in found], pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                found = [(memoryview(i).cast("I").tolist(), d.decode()) for i, d in pairs]
                columns = [pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.string())]
                names = ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *names])

    out = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return map_batches(keyed(rows, key, text), step, f"`{key}` {kind}, {out}")


def decode(rows: DataFrame, vocabulary: str, key: str = KEY, ids: str = "ids") -> DataFrame:
    """Decoded text of id lists: (key, ``decoded``). Null and empty lists give empty text; unknown ids are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(read_source(vocabulary))

    def step(batches):
        made = codec(shared.value)
        for batch in batches:
            texts = [made.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "decoded"])

    chosen = rows.select(rows[key].alias("key"), rows[ids].cast("array<int>").alias("ids"))
    return map_batches(chosen, step, f"`{key}` {key_type(rows, key)}, decoded string")
