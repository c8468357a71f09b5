"""The few functions without a built-in form, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object in prose that parses, or None. Braces in strings don't count."""
    if text is None:
        return None
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        json.loads(text[start : i + 1])
                    except ValueError:
                        break
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None


@F.pandas_udf(T.StringType())
def balanced_json(text: pd.Series) -> pd.Series:
    return text.map(first_object)


def fold(text: str | None) -> str | None:
    """Lower case without accents."""
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    return text.map(fold)


#: Endings of the published suffix-stripping algorithm, by step. Fixed values.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _shape(stem: str) -> str:
    return "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) < 3:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (m := re.search("(ed|ing)$", word)) and "v" in _shape(word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for end, new in sorted((x.split(":") for x in rules.split()), key=lambda x: -len(x[0])):
            if word.endswith(end):
                word = word[: len(word) - len(end)] + new if _measure(word[: len(word) - len(end)]) else word
                break
    for end in sorted(_STEP4.split(), key=len, reverse=True):
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


STEMS = 200_000


@functools.lru_cache(STEMS)
def stem_word(word: str) -> str:
    return porter(fold(word))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Each word of an array by its stem, accents folded: the terms of a stemmed keyword search."""
    return words.map(lambda found: None if found is None else [stem_word(w) for w in found])


_models: dict = {}


def embed(rows: DataFrame, load: Callable[[], Callable[[list[str]], list]], id_col: str = "id", text_col: str = "content", prefix: str = "") -> DataFrame:
    """``id`` and ``embedding`` of texts by a model that each Python worker loads once.

    ``load`` returns a function from texts to vectors; ``prefix`` is the task's, as some models want one. A worker
    keeps one model, and loads another where it is asked for one.
    """
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _models:
            _models.clear()
            _models[name] = load()
        model = _models[name]
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "embedding": model([prefix + (t or "") for t in batch["content"]])})

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content")).mapInPandas(run, "id long, embedding array<float>")
