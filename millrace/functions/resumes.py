"""Résumés cut into sections and parts, and prompts put together from sources. Column code, but for the
pages that sections begin on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from . import text

# --- fixed values: how a job's dates and the headings are written

MONTH = r"(?:январ\w*|феврал\w*|март\w*|апрел\w*|ма[йя]|июн\w*|июл\w*|август\w*|сентябр\w*|октябр\w*|ноябр\w*|декабр\w*)"
JOB_DATES = rf"{MONTH}\s+20\d{{2}}\s*[—–\-]\s*(?:\n\s*)?{MONTH}\s+20\d{{2}}"
HEADINGS = r"^(?:Образование|Навыки|Опыт вождения|Дополнительная информация)\s*$|^Обо мне\b"
#: What months and headings begin with in either case: a look at the letter, before the words are tried at its place.
BEFORE = "(?=[\u0400-\u04ff\u1c80-\u1c8f])"
KINDS = {"образование": "education", "навыки": "skills", "обо мне": "about"}
DURATION = r"\d+\s+(?:год|года|лет|месяц|месяца|месяцев)\b.*"
TECHNOLOGIES = r"(?:основные )?технологии"
#: Kinds of sections of which an excerpt is long.
LONG_KINDS = ["employment", "skills", "about", "education", "profile", "other"]
REPEAT_MARKERS = ["повторно проанализ", "проанализируй повторно", "проанализируй еще", "проанализируй ещё", "посмотри еще", "посмотри ещё", "ещё раз", "еще раз", "уточни", "детальнее", "подробнее"]
ATTRIBUTE_MARKERS = ["цвет", "оттен", "форма", "размер", "располож", "слева", "справа", "сверху", "снизу", "фон", "материал", "ствол", "дерев", "листв", "видно", "выгляд"]
PICTURE_MARKERS = ["картин", "изображ", "фото", "picture", "image", "photo"]


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """`make` of a value that is computed once, as the one element of an array."""
    return F.transform(F.array(value), make)[0]


def is_resume(content: Column) -> Column:
    """At least two date ranges of jobs."""
    return F.regexp_count(content, F.lit(f"{BEFORE}(?iuU:{JOB_DATES})")) >= 2


def organization(section: Column) -> Column:
    """The first line after the first that is no date, duration or dash; empty where there is none."""
    lines = F.filter(F.transform(F.split(section, "\n"), text.strip), lambda x: x != "")
    dates = rf"{BEFORE}(?iuU:{JOB_DATES})|(?iuUs:^(?:{MONTH}\s+20\d{{2}}\s*[—–\-]?|{DURATION}|[—–\-]+)$)"
    named = F.filter(F.slice(lines, 2, 10_000), lambda x: ~F.regexp_like(x, F.lit(dates)))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(""))


@pandas_udf(ArrayType(IntegerType()))
def _pages_of(sizes: pd.Series, lengths: pd.Series) -> pd.Series:
    """The page (from 1) that each piece begins on: where it begins, by running sums, looked up among the pages' beginnings."""
    out = []
    for of_pages, of_pieces in zip(sizes, lengths, strict=True):
        if of_pages is None or of_pieces is None:
            out.append(None)
            continue
        pages, pieces = np.asarray(of_pages, np.int64), np.asarray(of_pieces, np.int64)
        out.append(np.searchsorted(pages.cumsum() - pages, pieces.cumsum() - pieces, side="right").astype(np.int32))
    return pd.Series(out, dtype=object)


def sections(pages: Column) -> Column:
    """Array of struct(kind, content, organization, page) of a résumé's pages, or null where these aren't one.

    Pages are joined by line ends and cut before each job's dates and each heading; what stands before the first cut is the
    profile. A section's page is the one that it begins on.
    """
    clean = F.transform(pages, lambda p: text.strip(F.translate(F.coalesce(p, F.lit("")), "\u00a0\u202f", "  ")))
    whole = F.array_join(clean, "\n")
    pieces = F.split(whole, rf"{BEFORE}(?iumU:(?<!\w)(?={JOB_DATES})|(?<![^\n])(?={HEADINGS}))")
    numbers = _pages_of(F.transform(clean, lambda p: F.length(p) + 1), F.transform(pieces, F.length))

    def one(z: Column, i: Column) -> Column:
        piece = z["piece"]
        head = F.lower(F.regexp_extract(piece, r"\A([^\n]*)", 1))
        kind = F.when(F.regexp_like(piece, F.lit(rf"(?iuU)^{JOB_DATES}")), "employment")
        for word, name in KINDS.items():
            kind = kind.when(head.startswith(word), name)
        kind = F.coalesce(kind, F.when(i == 0, "profile").otherwise("other"))
        known = F.struct(kind.alias("kind"), text.strip(piece).alias("content"))
        return _bound(known, lambda k: F.struct(k["kind"].alias("kind"), k["content"].alias("content"), F.when(k["kind"] == "employment", organization(k["content"])).otherwise("").alias("organization"), z["page"].alias("page")))

    described = F.transform(F.arrays_zip(pieces.alias("piece"), numbers.alias("page")), one)
    return F.when(is_resume(whole), F.filter(described, lambda s: s["content"] != ""))


def anchor(content: Column, employer: Column) -> Column:
    """The employer's name and the lines on technologies, which each part of a long job repeats."""
    is_heading = lambda x: F.regexp_like(F.lower(x), F.lit(f"^{TECHNOLOGIES}"))
    lines = F.transform(F.split(content, "\n"), text.strip)
    at = lambda x: F.array_position(F.transform(x, is_heading), True).cast("int")
    two = _bound(lines, lambda x: _bound(at(x), lambda i: F.when(i > 0, F.slice(x, i, 2))))
    found = F.filter(two, lambda x: x != "")
    name = F.when(F.trim(employer) != "", F.concat(F.lit("Организация: "), F.trim(employer)))
    return F.concat_ws("\n", name, F.array_join(found, "\n"))


def parts(content: Column, kind: Column, employer: Column, size: int = 2200) -> Column:
    """A section in parts of at most `size` characters, without overlap; parts of a job begin with its anchor."""
    body = text.strip(content)
    # only a job that is cut needs what its parts repeat
    long_job = (kind == "employment") & (F.length(content) > size)
    head = _bound(F.when(long_job, anchor(content, employer)), lambda a: F.when(F.length(a) < size, a).otherwise(""))

    def cut(x: Column) -> Column:
        room = F.when(x["head"] == "", size).otherwise(size - F.length(x["head"]) - 1)
        starts = F.sequence(F.lit(0), F.greatest(F.length(x["body"]) - 1, F.lit(0)), room)
        pieces = F.filter(F.transform(starts, lambda s: text.strip(F.substring(x["body"], s + 1, room))), lambda p: p != "")
        headed = F.transform(pieces, lambda p: F.when((x["head"] == "") | F.contains(p, x["head"]), p).otherwise(F.concat(x["head"], F.lit("\n"), p)))
        whole = F.filter(F.array(x["body"]), lambda p: p != "")
        return F.when(F.length(x["body"]) <= size, whole).otherwise(F.transform(headed, lambda p: F.substring(p, 1, size)))

    return _bound(F.struct(body.alias("body"), head.alias("head")), cut)


def excerpt(content: Column, kind: Column, limit: int, long: int = 8000) -> Column:
    return F.when(kind.isin(*LONG_KINDS), F.substring(content, 1, long)).otherwise(F.substring(content, 1, limit))


def asks_picture_again(message: Column) -> Column:
    """A visual attribute, or a wish to look again at a picture. `форма` counts as a word of its own and not as `формат`."""
    low = F.lower(message)
    seen = text._any(low, [m for m in ATTRIBUTE_MARKERS if m != "форма"]) | F.regexp_like(low, F.lit("форма(?!т)"))
    return seen | (text._any(low, REPEAT_MARKERS) & text._any(low, PICTURE_MARKERS))


def prompt(question: Column, sources: Column, rules: Sequence[str], memory: Column | None = None, closing: Column | None = None) -> Column:
    """Rules, numbered sources (structs of title, source_type, file_name, features, content), memory, reminder and question."""
    block = lambda s, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), F.coalesce(s["source_type"], F.lit("unknown")), F.lit(" | title="), F.coalesce(s["title"], F.lit("Untitled")), F.lit(" | file="), F.coalesce(s["file_name"], F.lit("")), F.lit(" | feature="), F.when(F.size(s["features"]) > 0, F.array_join(s["features"], ", ")).otherwise("unknown"), F.lit("]\n"), text.strip(s["content"]))
    shown = F.when(F.size(sources) > 0, F.array_join(F.transform(sources, block), "\n\n")).otherwise("No context was found.")
    parts_ = [F.lit("Rules:\n" + "\n".join(f"- {r}" for r in rules)), F.concat(F.lit("Context:\n\n"), shown)]
    parts_ += [F.when(F.trim(c) != "", F.concat(F.lit(f"{name}:\n"), text.strip(c))) for name, c in (("Memory", memory), ("Reminder", closing)) if c is not None]
    return F.concat_ws("\n\n", *parts_, F.concat(F.lit("Question:\n"), question))
