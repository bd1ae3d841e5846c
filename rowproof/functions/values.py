"""Scalar functions on cell values: numbers, dates, normal forms, similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .empties import strip

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"
HAN = r"[一-龥]"
# Accepted spellings and formats.
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no", "是", "否", "y", "n", "on", "off")
TRUE_WORDS = ("true", "1", "yes", "是", "y", "on")
DATE_SHAPES = (r"\d{4}-\d{2}-\d{2}", r"\d{4}/\d{2}/\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{8}")
DATE_FORMATS = (
    (r"\d{4}-\d{1,2}-\d{1,2}", ("yyyy-M-d",)), (r"\d{4}/\d{1,2}/\d{1,2}", ("yyyy/M/d",)), (r"\d{1,2}/\d{1,2}/\d{4}", ("d/M/yyyy", "M/d/yyyy")),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", ("yyyy-M-d H:m:s",)), (r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", ("yyyy/M/d H:m:s",)), (r"\d{8}", ("yyyyMMdd",)),
)
PROMPT_WORDS = ("确认", "检查", "建议", "请", "是否", "或者", "可能", "需要", "应该", "必须", "注意", "提示", "警告", "说明", "参考", "数据源", "采集逻辑", "业务逻辑", "特定需求", "合理的", "问题", "错误", "修改", "更正", "调整")
ENTITY_SUFFIXES = ("股份有限公司", "有限公司", "集团", "股份公司", "公司", "集团股份有限公司", "（集团）股份有限公司", "Co.,Ltd", "Inc.", "Corp.", "Ltd.", "大学", "学院", "研究所", "研究院", "中心")
COMPANY_SUFFIXES = ("股份有限公司", "有限公司", "公司", "集团", "股份", "(集团)", "（集团）")
QUARTERS = {"Q1": ("q1", "一季度", "第一季度", "1季度"), "Q2": ("q2", "二季度", "第二季度", "2季度"), "Q3": ("q3", "三季度", "第三季度", "3季度"), "Q4": ("q4", "四季度", "第四季度", "4季度")}
STOP_WORDS = ("的", "了", "和", "是", "在", "有", "与", "对", "及", "等", "等等", "为", "以", "由", "被", "将", "可", "也", "都", "而", "本", "该", "此", "这", "那", "其", "之", "于", "从", "到", "课程", "本课程", "该课程", "学生", "设计", "提供", "介绍", "涵盖", "探讨", "包括", "教授")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def strip_currency(c: Column, spaces: bool = False) -> Column:
    return F.regexp_replace(c, r"[,¥$€£\s]" if spaces else r"[,¥$€£]", "")


def keep_numeric(c: Column) -> Column:
    """Digits, dots and minus signs only; '0' if none are left."""
    kept = F.regexp_replace(c, r"[^\d.\-]", "")
    return F.when(kept == "", "0").otherwise(kept)


def to_number(c: Column, spaces: bool = False) -> Column:
    """Double, or null where the text is no number (a shape guard comes before the cast)."""
    t = strip(strip_currency(c, spaces))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def is_integer(c: Column) -> Column:
    return strip(strip_currency(c)).rlike(INTEGER)


def is_number(c: Column) -> Column:
    return strip(strip_currency(c)).rlike(NUMBER)


def is_plain_decimal(c: Column) -> Column:
    return strip(c).rlike(r"^\d+\.\d+$")


def is_date(c: Column) -> Column:
    return strip(c).rlike("^(?:" + "|".join(DATE_SHAPES) + ")$")


def is_datetime(c: Column) -> Column:
    return is_date(F.substring_index(strip(c), " ", 1))


def is_boolean(c: Column) -> Column:
    return F.lower(strip(c)).isin(*BOOLEAN_WORDS)


def decimal_scale(c: Column) -> Column:
    """Digits after the dot; 0 without one; null for what is no number."""
    t = strip(strip_currency(c))
    return F.when(t.rlike(r"^[+-]?\d+(\.\d*)?$"), F.when(F.contains(t, F.lit(".")), F.length(F.substring_index(t, ".", -1))).otherwise(0))


def parse_date(c: Column) -> Column:
    """The first of the accepted formats that reads the text, without a time zone.

    A shape guard picks the formats worth trying: a parser that fails raises inside, which is dear by the row.
    """
    t = strip(c)
    chain = None
    for shape, formats in DATE_FORMATS:
        read = [F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in formats]
        read = F.coalesce(*read) if len(read) > 1 else read[0]
        hit = t.rlike(f"^{shape}$")
        chain = F.when(hit, read) if chain is None else chain.when(hit, read)
    return chain


def suggest_date(c: Column) -> Column:
    """ISO form of the other accepted shapes, else unchanged."""
    t = strip(c)
    return (
        F.when(t.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.replace(t, F.lit("/"), F.lit("-")))
        .when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.regexp_replace(t, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$1-$2"))
        .when(t.rlike(r"^\d{8}$"), F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
        .otherwise(t)
    )


def suggest_boolean(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin("t", "真", *TRUE_WORDS), "true").when(low.isin("f", "假", "false", "0", "no", "否", "n", "off"), "false").otherwise(c)


def valid_fix(c: Column) -> Column:
    """A data value rather than a sentence of advice."""
    hits = reduce(lambda a, b: a + b, (F.contains(c, F.lit(w)).cast("int") for w in PROMPT_WORDS))
    return F.coalesce((c != "") & (F.length(c) <= 100) & (hits < 2) & ~c.rlike("[。？！?!]"), F.lit(False))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the two sets of lower-cased characters."""
    chars = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != ""))
    x, y = chars(a), chars(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def _without(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), words, c)


def _within(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def similar_entities(a: Column, b: Column) -> Column:
    """Two different spellings that may name the same entity."""
    a, b = strip(a), strip(b)
    core_a, core_b = strip(_without(a, ENTITY_SUFFIXES)), strip(_without(b, ENTITY_SUFFIXES))
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    core_len = F.least(F.length(core_a), F.length(core_b))
    close = (1 - F.levenshtein(a, b) / longer > 0.9) & (shorter >= 5)
    cores = (core_a != "") & (core_b != "") & ((core_a == core_b) | (_within(core_a, core_b) & (core_len >= 2)))
    return F.coalesce((a != "") & (b != "") & (a != b) & ((_within(a, b) & (shorter >= 3)) | cores | close), F.lit(False))


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def chinese_entity_match(a: Column, b: Column) -> Column:
    """Abbreviation after suffix removal, same year and quarter, or half of the longer han words in common."""
    x, y = F.regexp_replace(a, r"\s+", ""), F.regexp_replace(b, r"\s+", "")

    def short_of(s: Column, full: Column) -> Column:
        core = _without(full, COMPANY_SUFFIXES)
        return (F.length(s) >= 4) & F.contains(full, s) & _within(s, core)

    year = lambda c: F.regexp_extract(c, r"(20\d{2})", 1)
    in_quarter = [reduce(lambda p, q: p | q, (F.contains(F.lower(a), F.lit(w)) for w in ws)) & reduce(lambda p, q: p | q, (F.contains(F.lower(b), F.lit(w)) for w in ws)) for ws in QUARTERS.values()]
    same_quarter = (year(a) != "") & (year(a) == year(b)) & reduce(lambda p, q: p | q, in_quarter)
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(rf"({HAN}{{3,}})"), F.lit(1)))
    wx, wy = words(x), words(y)
    fewest = F.least(F.size(wx), F.size(wy))
    common = (fewest > 0) & (F.size(F.array_intersect(wx, wy)) >= F.greatest(F.lit(1), fewest * 0.5))
    return (a != "") & (b != "") & (short_of(x, y) | short_of(y, x) | same_quarter | common)


def string_similarity(a: Column, b: Column) -> Column:

    def score(p: Column) -> Column:
        x, y = p["x"], p["y"]
        close = F.greatest(F.lit(0.0), 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))
        return F.when(x == y, 1.0).when(chinese_entity_match(x, y), 0.95).otherwise(close)

    normal = F.struct(F.lower(collapse_spaces(a)).alias("x"), F.lower(collapse_spaces(b)).alias("y"))
    return F.when(a == b, 1.0).otherwise(let(normal, score))


def _keywords(c: Column) -> Column:
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    phrases = F.regexp_extract_all(c, F.lit(rf"({HAN}{{2,6}})"), F.lit(1))
    phrases = F.filter(phrases, lambda p: ~F.array_contains(stop, p))
    pairs = F.flatten(F.transform(F.filter(phrases, lambda p: F.length(p) > 2), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2)))))
    words = F.filter(F.regexp_extract_all(c, F.lit(r"([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 1)
    return F.array_distinct(F.filter(F.concat(phrases, pairs, words), lambda w: ~F.array_contains(stop, w)))


def descriptive_match(expected: Column, generated: Column) -> Column:
    """Containment, or enough keywords in common."""
    clean = lambda c: F.regexp_replace(c, r"(?U)[^\w]", "")

    def shared(k: Column) -> Column:
        ke, kg = k["e"], k["g"]
        n = F.size(ke)
        near = lambda: F.size(F.filter(ke, lambda x: F.exists(kg, lambda q: F.contains(q, x) | F.contains(x, q))))
        return (n == 0) | (F.size(F.array_intersect(ke, kg)) >= 0.3 * n) | (near() >= 0.5 * n)

    def match(p: Column) -> Column:
        e, g = p["e"], p["g"]
        held = ((F.length(g) > 2 * F.length(e)) & F.contains(clean(g), clean(e))) | _within(e, g)
        return held | let(F.struct(_keywords(e).alias("e"), _keywords(g).alias("g")), shared)

    pair = F.struct(strip(F.lower(expected)).alias("e"), strip(F.lower(generated)).alias("g"))
    return F.when((expected == "") | (generated == ""), False).otherwise(let(pair, match))


def value_type(c: Column) -> Column:
    """null, numeric, date, boolean or string, from a cell's text."""
    t = F.replace(F.replace(strip(c), F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    return (
        F.when(c.isNull() | (c == ""), "null").when(t.rlike(NUMBER), "numeric")
        .when(strip(c).rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"), "date").when(F.lower(strip(c)).isin("true", "false", "yes", "no", "是", "否"), "boolean").otherwise("string")
    )


def normalise_number(c: Column) -> Column:
    """struct(value, decimals): commas and blanks dropped, trailing zeros not counted."""
    t = F.replace(F.replace(strip(c), F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    fraction = F.when(F.contains(t, F.lit(".")), F.rtrim(F.substring_index(t, ".", -1), F.lit("0"))).otherwise("")
    return F.named_struct(F.lit("value"), F.when(t.rlike(NUMBER), t.try_cast("double")), F.lit("decimals"), F.length(fraction))


def string_pattern(c: Column) -> Column:
    shapes = ((r"^\d{4}-\d{2}-\d{2}$", "date_iso"), (r"^\d{2}/\d{2}/\d{4}$", "date_us"), (r"^\d+$", "numeric"), (r"^\d+\.\d+$", "decimal"), (r"^[A-Z][a-z]+$", "capitalized_word"), (r"^[A-Z]+$", "uppercase"), (r"^[a-z]+$", "lowercase"))
    chain = F.when(c.isNull() | (c == ""), "empty")
    for shape, name in shapes:
        chain = chain.when(c.rlike(shape), name)
    return chain.otherwise("mixed")


def normalise_quarter(c: Column, mapping: dict[str, str], standard: tuple[str, ...]) -> Column:
    """Through the lower-cased mapping, else the first standard value contained, else null."""
    t = strip(c)
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    found = F.coalesce(*(F.when(F.contains(t, F.lit(s)), F.lit(s)) for s in standard)) if standard else F.lit(None)
    return F.coalesce(F.try_element_at(table, F.lower(t)), found)


def normalise_amount(c: Column, standard: str, conversions: list[tuple[str, str]]) -> Column:
    """Unchanged if it has the standard shape, else by the first conversion (pattern, template with {0}, {1}, ...)."""
    t = strip(c)
    chain = F.when(t.rlike(f"^(?:{standard})"), t)
    for pattern, template in conversions:
        to = template
        for k in range(9):
            to = to.replace(f"{{{k}}}", f"${k + 1}")
        chain = chain.when(t.rlike(f"^(?:{pattern})"), F.regexp_replace(F.regexp_extract(t, f"^(?:{pattern})", 0), f"^(?:{pattern})", to))
    return chain


def word_estimate(c: Column) -> Column:
    """Han characters plus runs of ASCII letters."""
    return (F.regexp_count(c, F.lit(HAN)) + F.regexp_count(c, F.lit("[a-zA-Z]+"))).cast("long")


def language(c: Column) -> Column:
    """zh if over a tenth of the characters are han, else en."""
    return F.when(F.regexp_count(c, F.lit(HAN)) / F.greatest(F.length(c), F.lit(1)) > 0.1, "zh").otherwise("en")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]+)$", 1)


def safe_file_name(c: Column) -> Column:
    """Characters that paths do not like become underscores."""
    return F.translate(c, '/\\:*?"<>| .', "___________")


def rating(c: Column) -> Column:
    """Score of a judge's answer, between 0 and 100; 0 if it has none."""
    tries = (r"Rating:\s*\[\[(\d+(?:\.\d+)?)\]\]", r'"overall_score":\s*(\d+(?:\.\d+)?)', r"(\d+(?:\.\d+)?)\s*分")
    first = F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in tries), F.lit("0"))
    return F.least(F.greatest(first.cast("double"), F.lit(0.0)), F.lit(100.0))


def rating_evidence(c: Column) -> Column:
    found = F.trim(F.regexp_extract(c, r"Evaluation evidence:\s*([^\n]+)", 1))
    return F.when(found != "", found).otherwise(F.substring(c, 1, 500))


def changes(c: Column) -> Column:
    """array of (field, old, new) from lines like 'field: old -> new'."""
    lines = F.regexp_extract_all(c, F.lit(r"(?m)^\s*[-*]?\s*([^:\n]+:\s*[^\n]*?\s*->\s*[^\n]*)$"), F.lit(1))
    part = lambda x, k: F.trim(F.regexp_extract(x, r"^([^:]+):\s*(.*?)\s*->\s*(.*)$", k))
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("field"), part(x, 2).alias("old"), part(x, 3).alias("new")))


def tagged_spans(c: Column) -> Column:
    """array of (entity, chunk) from <entity id=n><chunk>text</chunk>...</entity>."""
    entities = F.regexp_extract_all(c, F.lit(r"(?s)(<entity id=[^>]*>.*?</entity>)"), F.lit(1))
    return F.flatten(F.transform(entities, lambda e: F.transform(F.regexp_extract_all(e, F.lit(r"(?s)<chunk>(.*?)</chunk>"), F.lit(1)), lambda k: F.struct(F.regexp_extract(e, r"<entity id=[\"']?([^\"'>]*)", 1).alias("entity"), F.trim(k).alias("chunk")))))


def json_payload(c: Column) -> Column:
    """The JSON text in an answer: a fenced block, else the outermost braces or brackets; quotes repaired."""
    fenced = F.nullif(F.trim(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.lit(""))
    braces = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
    found = F.coalesce(fenced, braces)
    return F.regexp_replace(F.translate(found, "“”", '""'), r",\s*([}\]])", "$1")


def markdown_rows(c: Column) -> Column:
    """array of maps, one for each data row of the first pipe table (between table marks if there are any)."""
    body = F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)<TABLE BEGIN>(.*?)<TABLE END>", 1), F.lit("")), c)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s:|\-]+\|?$"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda y: F.trim(y))
    head = cells(F.try_element_at(lines, F.lit(1)))
    # rows shorter than the header are padded with '', longer ones cut
    fitted = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.size(head))), F.lit(1), F.size(head))
    rows = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.when(F.size(lines) < 2, F.array().cast("array<map<string,string>>")).otherwise(F.transform(rows, lambda x: F.map_from_arrays(head, fitted(cells(x)))))
