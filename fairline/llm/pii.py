"""Personal data: fixed forms, and identifiers found through the contexts that known ones stand in."""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fairline.llm.text import KEY, SPACES, TEXT, keyed, map_batches, numbered
from fairline.session import stage

KINDS = ("email", "ip", "card", "phone")
#: Rounds at least; they go on while patterns are added.
ROUNDS = 3
#: A pattern is trusted with this many different seeds or discovered instances and this share of its weight on one kind.
MIN_SEEDS, MIN_CONFIDENCE = 3, 0.8
#: Score of instances below which nothing is taken.
MIN_SCORE = 0.8
MIN_DIGITS = 5
SPANS = "array<struct<kind string, start int, stop int>>"
UNKNOWN, DOUBT = 0.25, 0.25

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
EDGES = "\"'“”‘’«»()[]{}<>.,;:!?"
#: Digit groups with spaces, brackets, dots and hyphens between, up to the end of a word; a dot before a space ends a sentence.
RUN = re.compile(rf"\+?[0-9](?:(?:[ ()-]|\.(?! ))*+[0-9])*(?=[{re.escape(EDGES)}]*(?:[{SPACES}]|\Z))")
#: Longer words and instances are held by their digest, so that rows stay small.
LONG = 200


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local letters before each @, from where the last match ended."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            found.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(part: str) -> str:
    return "".join(c for c in part if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed forms, by kind as listed, then by start. Matches that fail their check are dropped, not retried."""
    found = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 38 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


def named(part: str) -> str:
    """What an instance is known by: itself in lower case, or its digest."""
    return part.lower() if len(part) <= LONG else f"#{hashlib.md5(part.casefold().encode('utf-8', 'surrogatepass')).hexdigest()}"


class Contexts:
    """The two words before places of one text, lower case and without marks at their ends.

    Places are asked for in rising order: a long unspaced word is then read once, however many places it holds.
    """

    def __init__(self, text: str):
        self.text, self.word, self.first, self.asked, self.earlier = text, 0, 0, 0, ""
        self.from_, self.read, self.made = 0, 0, hashlib.md5()

    def before(self, at: int) -> str:
        """'' where there are fewer than two words."""
        text, end = self.text, at
        while end and text[end - 1] in SPACES:
            end -= 1
        if not end:
            return ""
        start, least = end, self.asked if self.asked <= end else 0
        while start > least and text[start - 1] not in SPACES:
            start -= 1
        if not least or start > least or text[least - 1] in SPACES:
            self.word = self.first = start
            self.earlier = self.word_before(start)
        self.asked = end
        return self.earlier and f"{self.earlier} {self.written(end)}"

    def written(self, end: int) -> str:
        """The word that starts at ``word``, as far as ``end``; a long one is digested from where it was last read to."""
        while self.first < end and self.text[self.first] in EDGES:
            self.first += 1
        a, b = self.first, end
        while b > a and self.text[b - 1] in EDGES:
            b -= 1
        if a == b:
            return named(self.text[self.word:end])
        if b - a <= LONG:
            return self.text[a:b].lower()
        if self.from_ != a or not a < self.read <= b:
            self.from_, self.read, self.made = a, a, hashlib.md5()
        self.made.update(self.text[self.read:b].casefold().encode("utf-8", "surrogatepass"))
        self.read = b
        return f"#{self.made.hexdigest()}"

    def word_before(self, end: int) -> str:
        while end and self.text[end - 1] in SPACES:
            end -= 1
        start = end
        while start and self.text[start - 1] not in SPACES:
            start -= 1
        return named(self.text[start:end].strip(EDGES) or self.text[start:end])


def words_before(text: str, at: int) -> str:
    """The two words before a place, lower case and without marks at their ends; '' where there are fewer."""
    return Contexts(text).before(at)


def run_at(text: str, start: int, least: int, most: int) -> tuple[int, int] | None:
    """The digit groups that start at the word's start ``start``, within ``least`` and ``most``, with brackets that belong to them."""
    if not (m := RUN.match(text, start, most)):
        return None
    end = m.end()
    if end == most < len(text):  # cut by what follows: only whole words
        while end > start and text[end - 1] not in SPACES:
            end -= 1
        while end > start and text[end - 1] not in "0123456789":
            end -= 1
    opened, closed = text.count("(", start, end), text.count(")", start, end)
    if closed > opened and start > least and text[start - 1] == "(":
        start -= 1
    elif opened > closed and text[end:end + 1] == ")":
        end += 1
    return start, end


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, str, str, int, int]]:
    """(kind or '', pattern, instance, start, end): the base spans, and what else looks like an identifier.

    That is a run of digit groups over several words, or else a word; with digits enough, or an @ in a word.
    """
    known, seen = Contexts(text), Contexts(text)
    out = [(kind, known.before(a), named(text[a:b]), a, b) for kind, a, b in sorted(taken, key=lambda s: s[1:])]
    spans, n, at, done = sorted((a, b) for _, a, b in taken), 0, 0, 0
    for m in MARK.finditer(text):
        at = m.start()
        if at < done:
            continue
        start = end = at
        while start > done and text[start - 1] not in SPACES:
            start -= 1
        while end < len(text) and text[end] not in SPACES:
            end += 1
        least, done = start, end
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        while n < len(spans) and spans[n][1] <= start:
            n += 1
        following = spans[n][0] if n < len(spans) else len(text)
        if following < end:
            continue
        if (run := run_at(text, start, least, following)) and run[1] >= end:
            start, end = run
            done = max(done, end)
        word = text[start:end]
        if len(digits_of(word)) < MIN_DIGITS and "@" not in word:
            continue
        if pattern := seen.before(start):
            out.append(("", pattern, named(word), start, end))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(rows: DataFrame) -> DataFrame:
    """Base spans of each text, and candidates with their contexts. ``rows``: one column to carry, ``rest``, and ``text``."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
    hint = pa.struct([("kind", pa.string()), ("pattern", pa.string()), ("instance", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def step(batches):
        for batch in batches:
            base, hints = [], []
            for t in batch.column(1).to_pylist():
                spans = base_spans(t) if MARK.search(t) else []
                base.append([dict(zip(("kind", "start", "stop"), s, strict=True)) for s in spans])
                hints.append([dict(zip(("kind", "pattern", "instance", "start", "stop"), c, strict=True)) for c in candidates(t, spans)]
                             if MARK.search(t) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(hints, pa.list_(hint))],
                                             names=["rest", "base", "hints"])

    found = StructType.fromDDL(f"base {SPANS}, hints array<struct<kind string, pattern string, instance string, start int, stop int>>")
    return map_batches(rows.select("rest", "text"), step, StructType([rows.schema["rest"], *found]))


def bootstrap(hints: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, instance, kind) of unseen identifiers, from (kind or '', pattern, instance) rows.

    The graph has an edge per pattern and instance. A seed scores 1 for its kind. A pattern's confidence in a kind is
    the sum of its instances' scores over their number, where what is still unknown of an unseen instance counts ``UNKNOWN``
    and one doubt is added. An unseen instance's score is 1 minus the product of (1 - confidence) of its trusted patterns.
    Each round scores the patterns from the seeds and the last instance scores, then the instances, by joins along the edges;
    sums are combined before they are shuffled. Discovered instances count among the ``MIN_SEEDS`` as seeds do, so they can
    make further patterns eligible. Scores and trusted patterns only grow; after ``rounds`` it ends with the first round that
    trusts no new pattern.
    """
    edges = stage(hints.where("pattern <> ''").groupBy("pattern", "instance").agg(F.max("kind").alias("seed")), "pii-edges")
    seeds = edges.where("seed <> ''")
    known = seeds.groupBy("pattern").agg(F.count("*").alias("known"))
    open_ = edges.where("seed = ''").select("pattern", "instance")
    unseen = open_.groupBy("pattern").agg(F.count("*").alias("unseen"))
    sizes = stage(unseen.join(known, "pattern", "left").select("pattern", "unseen", F.coalesce("known", F.lit(0)).alias("known")), "pii-patterns")
    seeded = stage(seeds.groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds"))
                   .join(sizes.select("pattern"), "pattern", "left_semi"), "pii-seeds")
    scores, trusted, before = None, None, 0
    for n in itertools.count(1):
        backed = seeded.select("*", F.lit(0).alias("found"), F.lit(0.0).alias("given"))
        if scores is not None:
            more = open_.join(scores, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("found"), F.sum("score").alias("given"))
            backed = seeded.join(more, ["pattern", "kind"], "full").na.fill(0, ["seeds", "found", "given"])
        confidence = (F.col("seeds") + F.col("given")) / (
            F.col("known") + F.col("given") + UNKNOWN * (F.col("unseen") - F.col("given")) + DOUBT)
        passed = backed.where(F.col("seeds") + F.col("found") >= MIN_SEEDS).join(sizes, "pattern").withColumn(
            "confidence", F.least(confidence, F.lit(0.999))).where(F.col("confidence") >= MIN_CONFIDENCE)
        trusted = stage(passed.select("pattern", "kind", "confidence"), f"pii-trusted-{n}")
        scores = stage(open_.join(trusted, "pattern").groupBy("instance", "kind")
                       .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")), f"pii-scores-{n}")
        held = trusted.count()
        if not held or n >= rounds and held == before:
            break
        before = held
    best = scores.where(F.col("score") >= MIN_SCORE).groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return stage(open_.join(trusted.select("pattern").distinct(), "pattern").join(best, "instance").select("pattern", "instance", "kind"), "pii-found")


def spans_of(rows: DataFrame, rounds: int) -> DataFrame:
    """(rest, base, spans) of rows with ``rest`` and ``text``."""
    found = stage(scan(rows).withColumn("row", F.monotonically_increasing_id()), "pii-scan")  # ids are fixed once written
    hints = found.select("row", F.inline("hints"))
    accepted = bootstrap(hints.select("kind", "pattern", "instance"), rounds)
    more = stage(hints.where("kind = ''").drop("kind").join(accepted, ["pattern", "instance"])
                 .groupBy("row").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("more")), "pii-more")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    every = F.concat("base", F.coalesce("more", F.array().cast(SPANS)))
    spans = F.array_sort(F.transform(every, lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    spans = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return found.drop("hints").join(more, "row", "left").select("rest", "base", spans.alias("spans"))


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def find(rows: DataFrame, key: str = KEY, text: str = TEXT, rounds: int = ROUNDS) -> DataFrame:
    """Personal data of every whole text: (key, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base``, ``spans``), a row per row.

    General: the reference has no prose records, so ``rows`` is any frame with a key and a text. ``base`` holds
    the fixed forms and ``spans`` these and the discovered ones (arrays of kind, start, stop in code points, stop exclusive,
    by kind, then start); the counts are of the base. Null and empty texts have no spans; repeated rows each give
    a row, null keys stay null, other columns are ignored.

    The method: base matches are seeds, the two words before a seed are its lexical pattern, and runs of digit groups
    and other words with digits or an @ that stand after the same words are candidate instances. :func:`bootstrap` scores the graph, whose discovered
    instances prove further patterns. A discovered
    identifier never overlaps a base span. Texts are read once; what is shuffled is one row per candidate.
    """
    found = spans_of(keyed(rows, key, text).withColumnRenamed("key", "rest"), rounds)
    counts = [F.size(F.filter("base", of_kind(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("rest").alias(key), *counts, "base", "spans")


def redact(rows: DataFrame, text: str = TEXT, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` with every span of :func:`find` in the text replaced by its kind, as <EMAIL>.

    Null texts become empty; repeated rows are kept; columns may have any name and type.
    """
    columns, at = rows.columns, rows.columns.index(text)
    whole = numbered(rows)
    whole = whole.select(F.struct(*whole.columns).alias("rest"), F.coalesce(F.col(f"c{at}").cast("string"), F.lit("")).alias("text"))
    found = spans_of(whole, rounds)
    schema = StructType([StructField(f"c{i}", StringType() if i == at else f.dataType) for i, f in enumerate(rows.schema)])

    def step(batches):
        for batch in batches:
            held = batch.column(0)
            texts = [mask(t or "", s) if s else t or "" for t, s in zip(held.field(at).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            fields = [pa.array(texts, pa.string()) if i == at else held.field(i) for i in range(held.type.num_fields)]
            yield pa.RecordBatch.from_arrays(fields, names=schema.names)

    return map_batches(found.select("rest", "spans"), step, schema).toDF(*columns)


def written(spans):
    """kind:start:stop of an array of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def mask(text: str, spans: list) -> str:
    """The text with every span replaced by its kind in brackets; spans that touch are replaced one by one, overlaps once."""
    out, done = [], 0
    for start, stop, kind in sorted((s["start"], s["stop"], s["kind"]) for s in spans):
        if start < done:
            if stop <= done:
                continue
            start = done
        out += [text[done:start], f"<{kind.upper()}>"]
        done = stop
    return "".join([*out, text[done:]])
