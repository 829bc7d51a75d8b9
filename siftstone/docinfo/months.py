"""Month names of many languages, from the locale data that the Java runtime brings along."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import SparkSession

#: Languages with written months; Chinese, Japanese and Korean write them as numbers
LANGUAGES = "bg ca cs cy da de el en es et eu fi fr ga gl he hr hu id is it lt lv mk mt nb nl pl pt ro ru sk sl sq sr sv tr uk vi".split()


def fold(name: str) -> str:
    """Lower case without accents and dots."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    return plain.replace("ł", "l").replace("ø", "o").replace("đ", "d").replace("ı", "i").strip(" .")


@functools.lru_cache(maxsize=1)
def _table(app: str) -> dict[str, int]:
    spark = SparkSession.getActiveSession()
    jvm = spark.sparkContext._jvm
    found: dict[str, set[int]] = {}
    styles = [jvm.java.time.format.TextStyle.valueOf(s) for s in ("FULL", "FULL_STANDALONE", "SHORT", "SHORT_STANDALONE")]
    months = list(jvm.java.time.Month.values())
    for language in LANGUAGES:
        locale = jvm.java.util.Locale.forLanguageTag(language)
        for style in styles:
            for n, month in enumerate(months, 1):
                name = fold(month.getDisplayName(style, locale))
                if len(name) >= 3 and name.isalpha():
                    found.setdefault(name, set()).add(n)
    return {k: min(v) for k, v in sorted(found.items()) if len(v) == 1}


def by_name(spark: SparkSession) -> dict[str, int]:
    """Folded names and abbreviations, in the form after a day too; those of two months in different languages are out."""
    return _table(spark.sparkContext.applicationId)
