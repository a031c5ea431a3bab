"""Personal information in a table of mails."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from email.errors import HeaderParseError
from email.header import decode_header

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapflow.llm.mail import mail_text
from trapflow.llm.pii import Lexicons, Model, find, redact, unwrapped
from trapflow.llm.pii_training import trained

#: Counts that a task holds before it hands them on.
HELD_COUNTS = 500_000
#: Words of the lexicons, a bound on what is sent to every executor; above it the work is refused.
MAX_WORDS = 5_000_000

_PEOPLE = re.compile(r"^(?:from|to|cc|bcc|reply-to|sender)[ \t]*:[ \t]*([^\r\n]*(?:\r?\n[ \t]+[^\r\n]*)*)", re.I | re.M)
_DISPLAY = re.compile(r'(?:"([^"<>\r\n]+)"|([^"<>@,\r\n]+))\s*<[^<>@\s]+@')
_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\Z")
_LOWER = re.compile(r"(?<![\w@.])[^\W\d_A-Z]{3,}(?![\w@])")


def _plain(display: str) -> str:
    if "=?" not in display:
        return display
    try:
        return "".join(x.decode(c or "ascii", "replace") if isinstance(x, bytes) else x for x, c in decode_header(display))
    except (HeaderParseError, LookupError, ValueError):
        return ""


def people(raw: str) -> list[tuple[str, str]]:
    """(given name, surname) of the display names in a mail's headers; surname empty if not given."""
    head = re.split(r"\r?\n[ \t]*\r?\n", raw, maxsplit=1)[0]
    out = []
    for value in _PEOPLE.findall(head):
        for quoted, bare in _DISPLAY.findall(value):
            name = _plain(quoted or bare).strip(" \t'\"")
            if "," in name:
                surname, _, given = (x.strip() for x in name.partition(","))
                words = [*given.split()[:1], *surname.split()[-1:]]
            else:
                words = name.split()
            if 1 <= len(words) <= 4 and words[0][:1].isupper() and all(_NAME_WORD.match(w.rstrip(".")) for w in words):
                out.append((words[0].lower(), words[-1].lower() if len(words) > 1 else ""))
    return out


class _Lower:
    """The lower-case words of a text; what a piece between blanks holds is remembered, up to a bound."""

    def __init__(self) -> None:
        self.words: set[str] = set()  # pieces that are one such word
        self.dull: set[str] = set()  # pieces without any
        self.mixed: dict[str, list[str]] = {}

    def __call__(self, text: str) -> set[str]:
        if len(self.words) + len(self.dull) + len(self.mixed) > HELD_COUNTS:
            self.__init__()
        pieces = set(text.split())
        out = pieces & self.words
        for piece in pieces - out - self.dull:
            got = self.mixed.get(piece)
            if got is None:
                got = _LOWER.findall(piece)
                if got == [piece]:
                    self.words.add(piece)
                elif got:
                    self.mixed[piece] = got
                else:
                    self.dull.add(piece)
            out.update(got)
        return out


def fit_lexicons(docs: DataFrame, doc_id: str, text: str, support: int = 2) -> Lexicons:
    """Given names, surnames and lower-case words of all mails.

    Names are those that headers show; a given name counts if two mails show it, or one with a
    surname; a lower-case word counts if ``support`` mails have it. Every row is read, whatever its
    ``doc_id``. Counts are combined in the tasks and over the cluster; the driver gets the words
    that count, at most MAX_WORDS: with a larger vocabulary a ValueError asks for more support.
    """
    rows = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: Counter[tuple[str, str]] = Counter()
        common: Counter[str] = Counter()
        lower = _Lower()

        def counts() -> pd.DataFrame:
            rows = [*((k, w, n) for (k, w), n in got.items()), *(("common", w, n) for w, n in common.items())]
            got.clear(), common.clear()
            return pd.DataFrame(rows, columns=["kind", "word", "n"])

        for pdf in batches:
            for t in pdf["text"]:
                for given, surname in set(people(t)):
                    if len(given) > 1:
                        got["given", given] += 2 if surname else 1
                    if surname:
                        got.update({("surname", x): 1 for x in {surname, *surname.split("-")} if len(x) > 1})
                common.update(lower(mail_text(t)))
                if len(got) + len(common) >= HELD_COUNTS:
                    yield counts()
        yield counts()

    counted = rows.mapInPandas(count, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    found: dict[str, set[str]] = {"given": set(), "surname": set(), "common": set()}
    counting = F.when(F.col("kind") == "surname", 1).when(F.col("kind") == "given", 2).otherwise(support)
    for r in counted.where(F.col("n") >= counting).limit(MAX_WORDS + 1).toLocalIterator():
        found[r["kind"]].add(r["word"])
    if sum(map(len, found.values())) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words: ask for more support")
    return Lexicons(frozenset(found["given"]), frozenset(found["surname"] - found["given"]), frozenset(found["common"] - found["surname"]))


def personal_information(docs: DataFrame, doc_id: str, text: str, lexicons: Lexicons | None = None, model: Model | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, finds, [redacted]): what each mail's text holds, as distinct (pii_type, pii_key), in order.

    ``redacted`` is the mail text with typed placeholders. Whole texts are read; null and empty ones
    have no finds; of rows with one doc_id each is read; other columns are ignored.
    """
    spark = docs.sparkSession
    lex = spark.sparkContext.broadcast(lexicons or fit_lexicons(docs, doc_id, text))
    weights = spark.sparkContext.broadcast(model or trained())
    schema = "doc_id bigint, finds array<struct<pii_type:string,pii_key:string>>" + (", redacted string" if with_text else "")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                body = unwrapped(mail_text(t))
                found = find(body, lex.value, weights.value)
                row = (d, [{"pii_type": k, "pii_key": x} for k, x in dict.fromkeys((s.kind, s.key) for s in found)])
                rows.append((*row, redact(body, found)) if with_text else row)
            yield pd.DataFrame(rows, columns=["doc_id", "finds", "redacted"] if with_text else ["doc_id", "finds"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(search, schema)
