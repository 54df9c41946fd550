"""Helpers shared by the text operators: row mapping over Arrow batches, words, tokenizer memos.

The reference keeps no prose. Its text records are raw feed bodies (results files, price snapshots)
and the labels of picks, so the text operators are general: they take any frame with a key column
(``match_id`` unless told otherwise) and a text column.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fairline.session import ship_package

KEY, TEXT = "match_id", "text"

#: Words are maximal runs of characters other than space and \t..\r, which is what bytes.split does.
SPACES = " \t\n\v\f\r"
#: A run of white space with the word after it; or what white space ends the text.
CHUNK = re.compile(rf"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+\Z")
#: White space for Unicode patterns that SPACES lacks; such texts take the library's own path.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Letters and digits below this code point have kept their classes in every Unicode version in use.
STABLE = re.compile("[ɐ-\U0010ffff]")

BATCH_CHARS = 2_000_000
MEMO_ENTRIES = 250_000


def keyed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, under fixed names, so that other columns can't clash. Null text is empty."""
    return rows.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def map_batches(rows: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with this package at hand on the workers."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(step, schema)


def key_type(rows: DataFrame, key: str) -> str:
    return rows.schema[key].dataType.simpleString()


def numbered(rows: DataFrame) -> DataFrame:
    """The columns named by position, so that no name can clash, need quoting or mean a field of another."""
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])


def slices(texts: list[str], most: int = BATCH_CHARS) -> Iterable[tuple[int, int]]:
    """(from, to) over ``texts``, each with about ``most`` characters; a longer text stands alone."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


class Memo:
    """What ``learn`` gives for each distinct piece; forgotten whole when it grows over its bound."""

    def __init__(self, learn: Callable[[list], dict], entries: int = MEMO_ENTRIES):
        self.learn, self.entries, self.known = learn, entries, {}

    def of(self, lists: list[list]) -> dict:
        """What is known, the pieces of ``lists`` included."""
        gc.disable()  # millions of small objects without cycles; the collector would walk them again and again
        pieces = set().union(*lists)
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > self.entries and self.known:
            self.known, new = {}, pieces
        if new:
            self.known.update(self.learn(list(new)))
        gc.enable()
        return self.known


_LOADED: dict[tuple, object] = {}


def once(kind: str, source: str, make: Callable[[], object]) -> object:
    """One object per worker process for each (kind, source)."""
    if (at := (kind, hash(source), len(source))) not in _LOADED:
        _LOADED[at] = make()
    return _LOADED[at]


def tokenizer(source: str):
    """The tokenizers library's object for the JSON text ``source``, without truncation and padding."""
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(source)
        made.no_truncation()
        made.no_padding()
        return made
    return once("tokenizer", source, make)


def read_source(path: str) -> str:
    """A vocabulary file's text; it is read on the driver and sent along, its size being the file's."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def specials(tok) -> list[str]:
    return [t.content for t in tok.get_added_tokens_decoder().values()]


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return letters
