"""Text expressions. Everything here is a Column built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the corpus language that results depend on. (?U) makes \\b, \\d and \\s Unicode, as the counts expect.
#: Question endings; also what question_marks counts.
ENDING = r"(?U)(요\?|까\?|나요|ㄹ까요|는지요|습니까|궁금)"
#: Question expressions, and the form of the evaluation set, which lets a word go on after the ending.
EXPRESSION = r"(?U)(\?+|[가-힣]+(?:요|까|나요|까요|지요|습니까|합니까|가요)\b|어떻게|무엇|언제|어디|얼마나|원인|이유)"
EXPRESSION_LOOSE = r"(\?+|[가-힣]+(?:요|까|나요|까요|지요|습니까|합니까|가요)|어떻게|무엇|언제|어디|얼마나|원인|이유)"
#: Signs of a change of subject.
SHIFT = r"(?U)(\n+|- |\*\s*|\d+\.\s*|그리고|또한|추가로|이외에도|아울러)"
#: Formal wordings that a colloquial question should not have.
FORMAL = r"(문의드립니다|여쭤보고자|궁금합니다|알고 싶습니다|말씀드립니다|관찰되는데|하고자 합니다|드리고자|바랍니다)"
#: What answers mention, and what makes an input a question.
HOSPITAL, VET = "동물병원", "수의사"
COST = r"(?U)(비용|가격|원대|만원|\d+\s*원)"
QUESTION = r"(\?|까요|나요|는지|습니까|궁금)"

_BLANK = r"\s\x{1C}-\x{1F}"


def strip(c: Column, also: str = "") -> Column:
    """Removes white space of any script at both ends (null stays null); `also` adds characters of a class."""
    return F.regexp_replace(c, rf"(?U)^[{_BLANK}{also}]+|[{_BLANK}{also}]+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    """Removes only these characters at both ends."""
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+$", "")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def first_line(c: Column) -> Column:
    return F.split(c, "\n")[0]


def clean_generated(c: Column) -> Column:
    """A model's answer: stripped, without quotes around it, its first line only."""
    unquoted = strip_chars(strip_chars(strip(c), '"'), "'")
    return strip(first_line(unquoted))


def slug(c: Column) -> Column:
    """Lower case, everything but letters and digits as one dash."""
    return strip_chars(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "-")


def last_part(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def arm_id(path: Column, model: Column, rules: Sequence[tuple[str, str]], dim: Column | None = None) -> Column:
    """The first rule whose text the path has (case-blind), else the model's last part; with @{dim}d in a sweep."""
    out = F.lit(None).cast("string")
    for text, arm in reversed(rules):
        out = F.when(F.lower(path).contains(text.lower()), F.lit(arm)).otherwise(out)
    out = F.coalesce(out, last_part(model))
    return out if dim is None else F.concat(out, F.lit("@"), dim.cast("string"), F.lit("d"))


def prefixed(kind: Column, text: Column, query_prefix: str, passage_prefix: str, wanted: bool = True) -> Column:
    """The text with its kind's prefix; prefixes that are wanted but empty are an error."""
    if wanted and not (query_prefix or passage_prefix):
        raise ValueError("prefixes are wanted, but both are empty")
    return F.concat(F.when(kind == "query", F.lit(query_prefix)).otherwise(F.lit(passage_prefix)), text)


def embed_field(content: Column, payload: Column, choice: str, separator: str = "\n") -> Column:
    if choice not in ("content", "content+payload"):
        raise ValueError(f"unknown choice {choice!r}")
    return content if choice == "content" else F.concat_ws(separator, content, payload)


def tokens(c: Column, kind: str | Callable[[Column], Column] = "words") -> Column:
    """White-space words of the lower-cased text, its pairs of neighbouring characters, or what a tokenizer of one's own makes of the text.

    A tokenizer is any function of a column, such as a pandas UDF around a morphological analyzer.
    """
    if callable(kind):
        return kind(c)
    low = F.lower(c)
    if kind == "words":
        return F.filter(F.split(low, r"\s+"), lambda t: t != "")
    if kind == "bigrams":
        plain = F.regexp_replace(low, r"\s+", "")
        return F.regexp_extract_all(plain, F.lit("(?s)(?=(..))"), F.lit(1))
    raise ValueError(f"unknown kind {kind!r}")


def fingerprint(settings: dict) -> Column:
    """SHA-1 of the settings as JSON with sorted keys."""
    import json

    return F.sha1(F.lit(json.dumps(settings, sort_keys=True, ensure_ascii=False)))
