"""Rules over short texts: features, intents, terms, names, paths and scores of an answer. All of it is Column code."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays, text

# --- fixed values: words and names that the rules are made of

#: What a rewritten question says before the topic, the summary and the features of the conversation so far.
TOPIC_BEFORE, SUMMARY_BEFORE, FEATURES_BEFORE = "Предыдущая тема: ", "Summary предыдущего диалога: ", "Ключевые features из предыдущего контекста: "

#: Keywords of a question's features, in the order in which features are listed.
FEATURES = {
    "notifications": ["notification", "notifications", "уведом", "slack", "telegram", "delivery", "доставк"],
    "csv_import": ["csv", "import", "импорт", "mapping", "validation", "assignee_email"],
    "permissions": ["permission", "permissions", "доступ", "роль", "роли", "прав", "viewer", "manager", "admin"],
    "reports": ["report", "reports", "отчет", "отчёт", "sla", "nps", "adoption", "metric", "метрик"],
    "search": ["search", "поиск", "найти", "фильтр", "assignee"],
    "webhooks": ["webhook", "webhooks", "retry", "signature", "payload"],
    "integrations": ["integration", "integrations", "интеграц", "github", "gitlab", "email"],
    "tasks": ["task", "tasks", "задач", "status", "priority", "due date"],
    "projects": ["project", "projects", "проект", "workspace"],
    "sprints": ["sprint", "sprints", "спринт", "velocity", "capacity"],
}
#: Names that a document's own text is searched for.
INGEST_FEATURES = ["tasks", "projects", "sprints", "notifications", "permissions", "csv_import", "search", "reports", "webhooks", "integrations"]
#: Markers of the intents, in the order of their priority.
INTENT_MARKERS = {
    "metric": ["metric", "metrics", "метрик", "вырос", "выросл", "снизил", "снижен", "adoption", "tickets", "тикет", "delay", "задержк"],
    "release_notes": ["release note", "release notes", "релиз", "релизн", "changelog", "change log", "что было выпущено", "что выпустили", "изменения"],
    "support_feedback": ["жалоб", "отзыв", "feedback", "клиенты сообщают", "клиент сообщает", "пользователи сообщают", "support", "тикет", "tickets"],
    "technical_root_cause": ["техническ", "причин", "root cause", "rate limit", "rate limits", "retry", "backoff", "worker", "очеред", "api"],
    "incident": ["incident", "инцидент", "что случилось", "что произошло", "impact", "влияние", "последств", "mitigation", "смягч", "affected", "затронул", "пострад", "эскалац"],
    "visual_chart": ["diagram", "diagrams", "диаграм", "chart", "charts", "график", "визуализац"],
    "visual_image": ["изображен", "изображён", "изображение", "картинк", "фото", "photo", "image", "picture"],
}
METRIC_QUESTIONS = ["какие метрики", "какие показатели", "метрики по", "показатели по", "какие kpi", "какие metrics", "which metrics"]
METRIC_REFUSALS = ["без метрик", "без metrics", "не перечисляй метрик", "не перечисляя метрики", "не нужны метрики", "не надо метрик", "не используй метрики", "не показывай метрики"]
STRONG_TECHNICAL = ["root cause", "rate limit", "rate limits", "retry", "backoff", "worker"]
#: Source types of the intents, the required one where there is one, and the threshold that replaces a higher one.
INTENT_SOURCES = {
    "metric": ["metric_row", "incident_note", "support_ticket", "release_note"],
    "release_notes": ["release_note"],
    "support_feedback": ["support_ticket", "incident_note", "metric_row"],
    "technical_root_cause": ["markdown", "incident_note", "support_ticket"],
    "incident": ["incident_note", "support_ticket", "metric_row"],
    "visual_chart": ["excel_chart", "image_digest"],
    "visual_image": ["image_targeted_digest", "image_digest", "image_ocr"],
}
INTENT_REQUIRED = {"metric": "metric_row", "visual_chart": "excel_chart", "visual_image": "image_digest"}
INTENT_THRESHOLDS = {"metric": 0.60, "technical_root_cause": 0.60, "visual_chart": 0.55, "visual_image": 0.55}
INVENTORY_MARKERS = ["какие файл", "какой файл", "список файл", "что за файл", "доступные файл", "какие документ", "доступные документ", "что доступно"]
HEADER_MARKERS = ["организац", "дата", "документ", "реквизит", "компан", "company", "document"]
EXCEL_STOP = ["xls", "xlsx", "excel", "hard_for_analis", "известно", "город", "срок", "годности", "объем", "объём", "цену", "цена", "кегу", "какой", "какая", "какие", "какую", "что", "про", "написано", "изображено", "картинке", "картинка", "продукта", "продукт", "указано", "алкоголь", "плотность"]
DOCX_STOP = ["docx", "document", "документ"]
EXCEL_TERM, DOCX_TERM = r"[A-Za-zА-Яа-яЁё_#][A-Za-zА-Яа-яЁё0-9_#.-]{2,}|\b\d+(?:[,.]\d+)?\b", r"[A-Za-zА-Яа-я_#][A-Za-zА-Яа-я0-9_#.-]{2,}|\b\d{2,}\b"
FILE_EXTENSIONS = "jpg|jpeg|png|gif|webp|bmp|pdf|docx|doc|xlsx|xls|txt|md|csv"
#: Names of files in a message: quoted, after a noun, beginning with a number, of one word.
FILE_NAMES = [
    rf'(?iuU)"([^\n"]+\.(?:{FILE_EXTENSIONS}))"',
    rf"(?iuU)(?:файл(?:е|а|у|ом)?|документе?|картинк[аеуи]|изображени[еяю]|image)\s+((?:[\w.-]+(?:\s+[\w.-]+){{0,5}})\.(?:{FILE_EXTENSIONS}))\b",
    rf"(?iuU)\b((?:\d+[\w.-]*(?:\s+[\w.-]+){{0,5}})\.(?:{FILE_EXTENSIONS}))\b",
    rf"(?iuU)\b([A-Za-z0-9_.-]+\.(?:{FILE_EXTENSIONS}))\b",
]
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
DOMAINS = ["tech_knowledge", "user_feedback", "business_metrics", "release_notes"]
FOLLOW_UP_MARKERS = ["а какие", "а какой", "а какая", "а что", "а почему", "а как", "из этих", "из них", "этих проблем", "эти проблемы", "самые критичные", "самое критичное", "что из этого", "что с этим делать", "что делать", "какой action plan", "action plan", "план действий", "какие действия", "что показать", "что показать po", "какие рекомендации", "рекомендации", "какие метрики", "какие показатели", "можешь без метрик", "без метрик", "без цифр", "по ним", "по нему", "по ней", "расскажи подробнее", "подробнее", "по этой теме", "это"]
SWITCH_MARKERS = ["а теперь про", "теперь про", "перейдем к", "перейдём к", "забудь", "другая тема", "а что с", "что с", "сравни это с", "сравни с"]
TOPIC_MARKERS = ["а теперь про", "теперь про", "перейдем к", "перейдём к"]
SOFT_FEATURES = ["reports"]

# --- features and intents


def question_features(message: Column) -> Column:
    return text.features(message, FEATURES)


def ingest_features(content: Column) -> Column:
    return text.features(content, {name: [name] for name in INGEST_FEATURES})


def contains_any(message: Column, markers: Sequence[str]) -> Column:
    return text._any(F.lower(message), markers)


def intent(message: Column) -> Column:
    """The first intent whose markers are in the message, or null. Metrics give way where they are refused, and to a
    strong technical marker unless they are asked for by name."""
    has = {name: contains_any(message, markers) for name, markers in INTENT_MARKERS.items()}
    has["metric"] = has["metric"] & ~contains_any(message, METRIC_REFUSALS) & (contains_any(message, METRIC_QUESTIONS) | ~contains_any(message, STRONG_TECHNICAL))
    out = F.lit(None).cast("string")
    for name in reversed(INTENT_MARKERS):
        out = F.when(has[name], name).otherwise(out)
    return out


def visual_intents(message: Column) -> Column:
    """Charts and images don't exclude each other: both apply where neither of the other intents does."""
    first = intent(message)
    both = (first == "visual_chart") & contains_any(message, INTENT_MARKERS["visual_image"])
    return F.when(both, F.array(F.lit("visual_chart"), F.lit("visual_image"))).when(first.isNull(), F.array().cast("array<string>")).otherwise(F.array(first))


def lower_threshold(current: Column, target: Column) -> Column:
    """A null threshold becomes the target, a higher one is lowered to it; a null target changes nothing."""
    return F.when(target.isNull(), current).otherwise(F.least(F.coalesce(current, target), target))


def route(message: Column, source_types: Column, threshold: Column, default: float | None = None) -> Column:
    """struct(intents, source_types, score_threshold, required): what the caller gave (a non-empty list, a threshold) stays;
    the default threshold is lowered to the intent's."""
    found = visual_intents(message)
    last = F.element_at(found, F.greatest(F.size(found), F.lit(1)))
    own = F.size(source_types) > 0
    lookup = lambda table, kind: F.create_map(*(x for k, v in table.items() for x in (F.lit(k), kind(v))))
    any_intent = F.size(found) > 0
    routed = F.when(own | ~any_intent, source_types).otherwise(F.try_element_at(lookup(INTENT_SOURCES, lambda v: F.array(*map(F.lit, v))), F.when(any_intent, last).otherwise("")))
    first = F.when(any_intent, F.element_at(found, 1)).otherwise("")
    target = F.try_element_at(lookup(INTENT_THRESHOLDS, F.lit), first)
    required = F.filter(F.transform(found, lambda i: F.try_element_at(lookup(INTENT_REQUIRED, F.lit), i)), lambda x: x.isNotNull())
    return F.struct(found.alias("intents"), routed.alias("source_types"), F.coalesce(threshold, lower_threshold(F.lit(default).cast("double"), target)).alias("score_threshold"), F.when(own, F.array().cast("array<string>")).otherwise(required).alias("required"))


# --- exact terms


def excel_terms(message: Column) -> Column:
    found = F.transform(F.regexp_extract_all(message, F.lit(f"({EXCEL_TERM})"), 1), lambda t: F.lower(F.regexp_replace(t, r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", "")))
    number = lambda t: F.regexp_like(t, F.lit(r"^\d+(?:[,.]\d+)?$"))
    long = lambda t: F.when(number(t), F.length(F.regexp_replace(t, r"\D", "")) >= 2).otherwise(F.length(t) >= 4)
    return F.array_distinct(F.filter(found, lambda t: (t != "") & ~t.isin(*EXCEL_STOP) & long(t)))


def docx_terms(message: Column) -> Column:
    found = F.transform(F.regexp_extract_all(message, F.lit(f"({DOCX_TERM})"), 1), lambda t: F.lower(F.regexp_replace(t, r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", "")))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*DOCX_STOP) & F.regexp_like(t, F.lit("[a-z0-9#]"))))


def long_numbers(message: Column) -> Column:
    return F.regexp_extract_all(message, F.lit(r"(\b\d{6,}\b)"), 1)


def docx_match_count(content: Column, wanted: Column) -> Column:
    """Terms in the content without its `File:` lines."""
    body = F.lower(F.array_join(F.filter(F.split(content, "\n"), lambda x: ~F.lower(text.strip(x)).startswith("file:")), "\n"))
    return F.transform(F.array(body), lambda b: F.size(F.filter(wanted, lambda t: F.contains(b, t))))[0]


def asks_inventory(message: Column) -> Column:
    """Whether a question is about which files there are."""
    return contains_any(message, INVENTORY_MARKERS)


def cost(prompt: Column, completion: Column, input_price: Column, output_price: Column) -> Column:
    """In dollars, by prices of a million tokens; a missing count is none, a missing price makes the cost unknown."""
    return (F.coalesce(prompt, F.lit(0)) * input_price + F.coalesce(completion, F.lit(0)) * output_price) / 1_000_000


# --- texts of the feedback corpus


def slice_flag(content: Column, limit: int = 1200) -> Column:
    """struct(text, truncated)."""
    return F.struct(F.substring(content, 1, limit).alias("text"), (F.length(content) > limit).alias("truncated"))


def chunk_content(body: Column, index_text: Column) -> Column:
    return slice_flag(text.mask_pii(text.strip(F.coalesce(index_text, body))))["text"]


def corpus_id(number: Column) -> Column:
    return F.format_string("fb-v1-%04d", number)


def nfc(value: Column | str) -> Column:
    """The composed normal form; a text that it can't change isn't handed to Python."""
    return text.composed(value)


def named_ids(answer: Column, vocabulary: Sequence[str]) -> Column:
    """Words of the vocabulary, at the first place of each."""
    return F.array_distinct(F.filter(F.regexp_extract_all(answer, F.lit("([A-Za-z0-9_]+)"), 1), lambda t: t.isin(*vocabulary)))


def must_not_hits(answer: Column, phrases: Sequence[str]) -> Column:
    """The phrases, as written, that stand in the answer in any case; blank ones never do."""
    low = F.lower(nfc(answer))
    composed = {p: unicodedata.normalize("NFC", p).lower() for p in phrases if p.strip()}
    return F.filter(F.array(*(F.when(F.contains(low, F.lit(c)), F.lit(p)) for p, c in composed.items())).cast("array<string>"), lambda p: p.isNotNull())


def marker_scores(answer: Column, retrieved: Column, expected: Sequence[str], must_not: Sequence[str], vocabulary: Sequence[str]) -> Column:
    """An answer's scores: what was retrieved and named of the expected ids, and whether what it names is in the sources."""
    wanted = F.array(*map(F.lit, dict.fromkeys(expected)))
    sources = F.array_distinct(F.filter(retrieved, lambda x: x != ""))
    named, hits = named_ids(answer, vocabulary), must_not_hits(answer, must_not)
    support = F.when(F.size(named) == 0, 1.0).otherwise(F.size(F.array_intersect(named, sources)) / F.size(named))
    return F.struct(
        arrays.recall(wanted, sources).alias("retrieval_recall"),
        F.when(F.size(hits) > 0, 0.0).otherwise(support).alias("faithfulness"),
        arrays.recall(wanted, named).alias("answer_coverage"),
        support.alias("support_ratio"),
        F.array_intersect(named, sources).alias("supported"),
        F.array_except(named, sources).alias("unsupported"),
        hits.alias("must_not_hits"),
    )


def numbers_in(content: Column) -> Column:
    """Normal forms of the numbers in a text."""
    return F.transform(F.regexp_extract_all(content, F.lit(r"(?U)((?<!\w)\d[\d\s\u00a0.,]*\d|\b\d\b)"), 1), text.numeric_normal_form)


def has_numbers(content: Column, required: Sequence[str]) -> Column:
    """All required numbers are in the text, whatever their separators."""
    return F.size(F.array_except(F.array(*(text.numeric_normal_form(F.lit(x)) for x in required)), numbers_in(content))) == 0


def failed_flags(flags: Column) -> Column:
    """Names of a map's flags that are false; other kinds of values are no flags."""
    return F.map_keys(F.map_filter(flags, lambda k, v: v == "false"))


def quality_flags(answer: Column, source_types: Column, *, groups: Sequence[Sequence[str]] = (), forbidden: Sequence[str] = (), numbers: Sequence[str] = (), required_types: Sequence[str] = (), features: Mapping[str, Sequence[Column]] | None = None, provider: tuple[Column, str] | None = None) -> Column:
    """A map of named checks on an answer and the types of its sources; checks that a scenario doesn't ask for are left out."""
    checks: dict[str, Column] = {"response_is_not_empty": text.strip(F.coalesce(answer, F.lit(""))) != ""}
    if groups:
        checks["response_has_required_markers"] = text.groups_present(answer, groups)
    if forbidden:
        checks["response_has_no_forbidden_markers"] = ~contains_any(answer, forbidden)
    if numbers:
        checks["response_has_required_numbers"] = has_numbers(answer, numbers)
    if required_types:
        checks["sources_have_required_types"] = has_all(source_types, required_types)
    for name, places in (features or {}).items():
        checks[f"context_has_{name}"] = F.coalesce(F.exists(F.array(*(F.coalesce(F.array_contains(p, name), F.lit(False)) for p in places)), lambda x: x), F.lit(False))
    if provider:
        checks["provider_is_expected"] = F.coalesce(provider[0] == provider[1], F.lit(False))
    return F.create_map(*(x for name, c in checks.items() for x in (F.lit(name), F.coalesce(c, F.lit(False)))))


def has_all(values: Column, required: Sequence[str]) -> Column:
    """The required values are a subset; of nothing required anything is."""
    return F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.coalesce(values, F.array().cast("array<string>")))) == 0


def sql_key(statement: Column) -> Column:
    """A statement for comparison as text: out of its fence, one space between words, lower case, no last semicolon."""
    return F.lower(F.regexp_replace(text.sql_in_fence(statement), text.SPACE, " "))


# --- names, paths and dates


def source_type_of(path: Column) -> Column:
    """What a file is by its folders, else by its extension."""
    parts, name = F.split(path, "/"), F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)
    inside = lambda folder: F.array_contains(parts, folder)
    csv = F.when(inside("business_metrics"), "metric_row").when(inside("user_feedback"), "support_ticket")
    release = F.when(name.contains("incident"), "incident_note").otherwise("release_note")
    other = F.when(inside("release_notes"), release).when(inside("tech_knowledge"), "markdown").when(suffix == "", "text").otherwise(suffix)
    return F.coalesce(F.when(suffix == "csv", csv), other)


def domain_of(path: Column) -> Column:
    parts, out = F.split(path, "/"), F.lit("documents")
    for domain in reversed(DOMAINS):
        out = F.when(F.array_contains(parts, domain), domain).otherwise(out)
    return out


def file_names(message: Column) -> Column:
    """Files that a message names, by all patterns in turn; of names that differ in case only the first."""
    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(p), 1), lambda x: F.trim(F.regexp_replace(x, text.SPACE, " "))) for p in FILE_NAMES)))
    kept = F.filter(found, lambda x: x != "")

    def first_of_case(names: Column) -> Column:
        low = F.transform(names, F.lower)
        return F.filter(names, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)

    return F.transform(F.array(kept), first_of_case)[0]


def close_date(day: Column) -> Column:
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), month, F.lit(" "), F.year(day).cast("string"), F.lit(" ("), F.date_format(day, "yyyy-MM-dd"), F.lit(")"))


def approach(value: Column) -> Column:
    """hybrid for a blank or unknown one; openapi is external."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low == "openapi", "external").when(low.isin("external", "local_only"), low).otherwise("hybrid")


def finish_reason(value: Column) -> Column:
    """Null for a blank one; names that aren't known stay as they are."""
    bare = F.trim(value)
    return F.when(F.lower(bare).isin("length", "max_tokens"), "length").when(F.lower(bare) == "stop", "stop").when(bare != "", bare)


def consistency(document: Column, visual: Column, agreeing: Mapping[str, str]) -> Column:
    """inconsistent where a document says a word of `agreeing` and the picture the word it stands against."""
    clash = F.lit(False)
    for said, seen in agreeing.items():
        clash = clash | (F.contains(F.lower(document), F.lit(said)) & F.contains(F.lower(visual), F.lit(seen)))
    return F.when(clash, "inconsistent").otherwise("consistent")


def allowed_topics(topics: Column, allowed: Sequence[str]) -> Column:
    """struct(kept, discarded): topics that are allowed in any case, as the allowed names write them, and the others."""
    names = {a.lower(): a for a in allowed}
    clean = F.filter(F.transform(topics, lambda t: F.trim(t)), lambda t: t != "")
    kept = F.array_distinct(F.filter(F.transform(clean, lambda t: F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.lower(t))), lambda t: t.isNotNull()))
    return F.struct(kept.alias("kept"), F.array_distinct(F.filter(clean, lambda t: ~F.lower(t).isin(*names))).alias("discarded"))


BEYOND = "\U0001f600"  # any letter beyond U+FFFF


def contexts(content: Column, word: str, around: int = 100) -> Column:
    """For each mention of a word, in any case and none inside another, the text from `around` characters before it to as many
    after it, lower-cased: one piece a mention."""
    low = re.sub(r"([^\w\s])", r"\\\1", word.lower())
    if not low:
        raise ValueError("a word is asked for")
    # What stands before is looked for backwards: `around` characters by one step, or, near its beginning, all of the text. Java
    # counts the pairs of letters beyond U+FFFF as one character each where such a letter is in the pattern.
    pattern = F.lit(rf"(?s)(?={low})(?:(?<=(.{{{around}}}|{BEYOND}{{{around}}}))|(?<=(\A.{{0,{around - 1}}}|\A{BEYOND}{{0}}))){low}(?=(.{{0,{around}}}))")
    group = lambda body, n: F.regexp_extract_all(body, pattern, n)
    before = lambda body: F.zip_with(group(body, 1), group(body, 2), lambda a, b: F.concat(a, b))
    pieces = lambda body: F.zip_with(before(body), group(body, 3), lambda a, b: F.concat(a, F.lit(word.lower()), b))
    return F.transform(F.array(F.lower(content)), pieces)[0]


# --- conversations


def is_topic_switch(message: Column, features: Column, follow_up: Column, soft: Sequence[str] = SOFT_FEATURES, markers: Sequence[str] = SWITCH_MARKERS) -> Column:
    """A feature that isn't soft, or any without a follow-up, or one beside a marker."""
    hard = F.size(F.array_except(features, F.array(*map(F.lit, soft)).cast("array<string>"))) > 0
    return (F.size(features) > 0) & (hard | ~follow_up | contains_any(message, markers))


def topic_query(message: Column, markers: Sequence[str] = TOPIC_MARKERS) -> Column:
    """The message from its first marker on, the markers tried in their order."""
    out = message
    for marker in reversed(markers):
        at = F.instr(F.lower(message), marker)
        out = F.when(at > 0, F.regexp_replace(F.substring(message, at, F.length(message)), r"^[ ,.]+|[ ,.]+$", "")).otherwise(out)
    return out
