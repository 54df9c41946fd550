"""Line-first cleaning: rules per line, then a verdict on what the document lost."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from fairline.llm.text import KEY, SPACES, TEXT, key_type, keyed, map_batches, numbered

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MAX_LOST = 0.5     # of the words
SYMBOLS = "#*$%&|<>"
#: A line with this share of words that end in a run of marks, or of separators among its words, fails.
MARKED_SHARE, SEPARATOR_SHARE = 0.3, 0.25
BOILERPLATE_WORDS = 40

MARKED = re.compile(r"[#*$%&!?=~^_<>]{2,}$")
SENTENCE = re.compile(r"[.!?…,;:。！？،]")
SEPARATORS = frozenset(["|", "||", "»", "«", ">", ">>", "<", "<<", "•", "·", "/", "//", "::", "→", "-", "–", "—"])
#: Phrases of page furniture and licence notes (fixed values, lower case).
BOILERPLATE = re.compile("|".join([
    r"all rights reserved", r"licensed under", r"released under the", r"copyright (?:©|\(c\)|\d{4})", r"©\s*\d{4}",
    r"terms of (?:use|service)", r"privacy policy", r"cookie (?:policy|settings)", r"we use cookies", r"enable javascript",
    r"click here", r"read more", r"sign (?:in|up) (?:to|for)", r"log in to", r"subscribe to", r"share (?:this|on)",
    r"back to top", r"skip to (?:main )?content", r"tous droits réservés", r"todos los derechos reservados",
    r"alle rechte vorbehalten",
]))


def line_fault(line: str, words: list[str]) -> str:
    """Which rule a line with words fails: punctuation, navigation, boilerplate, or ''."""
    n = len(words)
    if n >= 3 and sum(w in SEPARATORS for w in words) >= SEPARATOR_SHARE * n:
        return "navigation"
    if sum(1 for w in words if MARKED.search(w)) > MARKED_SHARE * n:
        return "punctuation"
    if n >= 3 and not SENTENCE.search(line):
        return "punctuation"
    if n <= BOILERPLATE_WORDS and BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that the text holds twice or more, its first place included."""
    n = len(words)
    if n < 4:
        return 0
    ids = np.fromiter(map({}.setdefault, words, range(n)), np.int64, n)
    if n >= 1 << 21:  # three numbers don't fit one key: number the pairs first
        _, pair = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)
        window = (pair[:-1].astype(np.int64) << 32) | ids[2:]
    else:
        window = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift:n - 2 + shift] |= again
    return int(inside.sum())


def inspect(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed lines by rule, clean text)."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen, lines, kept, removed, lost = set(), 0, [], {"navigation": 0, "punctuation": 0, "boilerplate": 0}, 0
    for line in text.split("\n"):
        found = line.encode().split()
        if not found:
            kept.append(line)
            continue
        lines += 1
        seen.add(line)
        if fault := line_fault(line, [w.decode() for w in found]):
            removed[fault] += 1
            lost += len(found)
        else:
            kept.append(line)
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    return (n, chars, symbols, lines - len(seen), repeated, failed, not failed and lost <= MAX_LOST * n,
            *removed.values(), "\n".join(kept))


FIELDS = ["n_words bigint", "word_chars bigint", "n_symbols bigint", "n_dup_lines bigint", "n_repeat_words bigint",
          "base_failed boolean", "kept boolean", "navigation_lines bigint", "punctuation_lines bigint", "boilerplate_lines bigint",
          "clean_text string"]


def clean(rows: DataFrame, key: str = KEY, text: str = TEXT) -> DataFrame:
    """Rules per line, failing lines taken out, and documents that lose too much rejected; a row per row.

    General: the reference has no prose records, so ``rows`` is any frame with a key and a text.
    Returns the key with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed`` (under 50
    words, or more than half of them in repeated 3-word windows), ``kept``, the lines removed by each rule and ``clean_text``.
    ``kept`` is false where the base failed or the removed lines held more than half of the words.
    Null and empty texts have no words, so they fail; repeated rows each give a row, null keys stay null, other
    columns are ignored, lines without a word are left alone. No shuffle: a document is judged by itself.
    """
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    names, types = zip(*[(f.split()[0], kinds[f.split()[1]]) for f in FIELDS], strict=True)

    def step(batches):
        for batch in batches:
            found = list(zip(*map(inspect, batch.column(1).to_pylist()), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(found, types, strict=True))],
                                             names=[key, *names])

    return map_batches(keyed(rows, key, text), step, f"`{key}` {key_type(rows, key)}, {', '.join(FIELDS)}")


def keep(rows: DataFrame, text: str = TEXT) -> DataFrame:
    """The rows whose text :func:`clean` keeps, all columns, with the clean text in place of the text.

    Null and empty texts fail and go; repeated rows are judged each; columns may have any name and type.
    """
    columns, at = rows.columns, rows.columns.index(text)
    schema = StructType([StructField(f"c{i}", StringType() if i == at else f.dataType) for i, f in enumerate(rows.schema)])

    def step(batches):
        for batch in batches:
            found = [inspect(t or "") for t in batch.column(at).to_pylist()]
            fields = [pa.array([f[-1] for f in found], pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(fields, names=schema.names).filter(pa.array([f[6] for f in found], pa.bool_()))

    return map_batches(numbered(rows), step, schema).toDF(*columns)
