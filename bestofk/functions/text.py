"""Answer extraction and comparison rules as native column expressions.

All of it stays in the JVM: regular expressions over whole texts, no Python workers.
Character classes are ASCII (``\\d``, ``\\s``), in Spark as in the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that define an answer.
NUMBER = r"-?\$?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\$?\d+(?:\.\d+)?%?"
HASHED = r"####\s*(" + NUMBER + r")"
BOXED_NUMBER = r"\\boxed\s*\{\s*(" + NUMBER + r")\s*\}"
ANSWER_IS = r"(?i)(?:the\s+)?answer\s+is[\s:=]*(" + NUMBER + r")"
TRIGGER = r"(?is)(?:final\s+answer|the\s+answer\s+is|answer)\s*[:\-]?\s*"
SPAN_CHARS = 160
TOKEN_EDGES = "().,:;!?\"'*` "
PAREN_LETTER = r"\(\s*([A-Ra-r])\s*\)"
LONE_LETTER = r"(?<![A-Za-z])([A-Ra-r])(?![A-Za-z])"
INTEGER = r"-?\d+"
FENCE = r"(?s)```(?:python|py)?\s*\n(.*?)```"
METHOD = r"def\s+(\w+)\s*\(\s*self"
TOLERANCE = 1e-9


def strip(text: Column) -> Column:
    """Remove white space, not only blanks, from both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+\z", "")


def squash(text: Column) -> Column:
    """Drop every white-space character."""
    return F.regexp_replace(text, r"\s+", "")


def render(template: str, fields: Mapping[str, Column]) -> Column:
    """Fill the ``{name}`` places of a format string (``{{`` is a brace). Field text is never read again."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(fields[name].cast("string"))
    return F.concat(*parts)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


Step = Callable[[Mapping[str, Column]], Mapping[str, Column] | Column]


class Steps:
    """A rule (text, truth) -> value in steps: each adds named values made from those before it, the last gives the result.

    As a call it is one expression, bound by ``let``, which Spark interprets row by row. ``scorers.native_scores`` makes a projection of
    each step instead, so that Spark compiles it; there, values of one name made in the same step of several rules have one type.
    """

    def __init__(self, *steps: Step, inputs: tuple[str, ...] = ("text", "truth")) -> None:
        self.steps, self.inputs = steps, inputs

    def __call__(self, *inputs: Column) -> Column:
        return self._bind(dict(zip(self.inputs, inputs, strict=True)), self.steps)

    def _bind(self, known: dict[str, Column], steps: tuple[Step, ...]) -> Column:
        made = steps[0](known)
        if len(steps) == 1:
            return made
        pack = F.struct(*[value.alias(name) for name, value in made.items()])
        return let(pack, lambda v: self._bind(known | {name: v[name] for name in made}, steps[1:]))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


# --- numbers ---------------------------------------------------------------

def number_value(token: Column) -> Column:
    """Numeric value of an answer token; null when what remains is not a number (``-$50``).

    One pass drops commas, leading ``$`` and trailing ``%``. A cast alone would also take Java's type
    suffixes (``1d``), so tokens with those letters have no value.
    """
    bare = F.regexp_replace(token, r"^\s*[,$]*|[,%]*\s*\z|,", "")
    return F.when(~token.rlike("[dDfF]"), bare.try_cast("double"))


def _token_value(token: Column) -> Column:
    """``number_value`` of a match of NUMBER, which holds no letters and no white space."""
    return F.ltrim(F.translate(token, ",%", ""), F.lit("$")).try_cast("double")


#: The matches of NUMBER that have no value. No match holds a minus but at its start, so these are found at any place.
VALUELESS = r"-\$\d{1,3}(?:,\d{3})+(?:\.\d+)?|-\$\d+(?:\.\d+)?%?"


def last_number(text: Column) -> Column:
    """The last number in the text that has a value."""
    valued = F.when(text.contains("-$"), F.regexp_replace(text, VALUELESS, " ")).otherwise(text)
    return _token_value(last_match(valued, NUMBER, 0))


# Fixed text that a pattern needs is looked for first.
NUMBER_RULES = {
    "hashed": lambda text: F.when(text.contains("####"), _token_value(last_match(text, HASHED))),
    "boxed": lambda text: F.when(text.contains("\\boxed"), _token_value(last_match(text, BOXED_NUMBER))),
    "answer_is": lambda text: _token_value(last_match(text, ANSWER_IS)),
    "bare": last_number,
}


def number_in(text: Column) -> Column:
    """The text's answer as a number: the first rule in priority order that gives a value."""
    return F.coalesce(*[rule(text) for rule in NUMBER_RULES.values()])


def with_number(df: DataFrame, text: str, value: str, tag: str) -> DataFrame:
    """Add the extracted number and the name of the rule that found it.

    One column per rule, each guarded by its predecessors, so a later (costlier) pattern
    only runs on rows the earlier ones left open and no pattern runs twice.
    """
    found: list[str] = []
    for name, rule in NUMBER_RULES.items():
        open_row = F.lit(True)
        for earlier in found:
            open_row = open_row & F.col(earlier).isNull()
        column = f"__{value}_{name}"
        df = df.withColumn(column, F.when(open_row, rule(F.col(text))))
        found.append(column)
    which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in zip(found, NUMBER_RULES)], F.lit("none"))
    return df.withColumns({value: F.coalesce(*[F.col(c) for c in found]), tag: which}).drop(*found)


def is_close(a: Column, b: Column) -> Column:
    margin = F.greatest(F.lit(TOLERANCE) * F.greatest(F.abs(a), F.abs(b)), F.lit(TOLERANCE))
    return F.abs(a - b) <= margin


def both_close(a: Column, b: Column) -> Column:
    """``is_close`` for costly sides: each is evaluated once. False when a side is null."""
    pair = F.struct(a.alias("a"), b.alias("b"))
    return F.coalesce(let(pair, lambda v: is_close(v["a"], v["b"])), F.lit(False))


numeric_utility = Steps(
    lambda v: {"got": number_in(v["text"]), "want": number_in(v["truth"])},
    lambda v: F.coalesce(is_close(v["got"], v["want"]), F.lit(False)).cast("double"),
)


# --- boxed answers ---------------------------------------------------------

BOX_OPEN = r"\\boxed\s*\{"
BRACE_LEVELS = 7


def _balanced(levels: int) -> str:
    """Regex for text whose braces balance, nested up to ``levels``, without a further box."""
    plain = r"[^{}\\]++|\\(?!boxed\s*\{)."
    body = f"(?:{plain})*+"
    for _ in range(levels):
        body = f"(?:{plain}|\\{{{body}\\}})*+"
    return body


_BODY = _balanced(BRACE_LEVELS)
FLAT_BOX = f"(?s){BOX_OPEN}({_BODY})\\}}"
# A box the flat pattern cannot decide: it holds another box or an unresolved brace.
OPEN_CASE = f"(?s)\\\\\\\\boxed\\s*\\{{|{BOX_OPEN}{_BODY}(?:\\\\boxed|\\{{)"
BRACE_TOKEN = r"(?s)\\+boxed\s*\{|\\.|[{}]|[^\\{}]+|\\"


def _last_box_by_stack(text: Column) -> Column:
    """Exact brace matching at any depth: one fold over the brace tokens of the text."""
    tokens = F.regexp_extract_all(text, F.lit(BRACE_TOKEN), F.lit(0))
    start = F.struct(
        F.lit(0).alias("pos"),
        F.array().cast("array<struct<at:int,box:boolean>>").alias("open"),
        F.lit(-1).alias("lo"),
        F.lit(-1).alias("hi"),
    )

    def step(acc: Column, token: Column) -> Column:
        after = acc["pos"] + F.length(token)
        is_box = token.startswith("\\") & token.endswith("{") & (F.length(token) > 2)
        opens = is_box | (token == "{")
        closes = (token == "}") & (F.size(acc["open"]) > 0)
        top = F.try_element_at(acc["open"], F.lit(-1))
        better = F.coalesce(closes & top["box"] & (top["at"] > acc["lo"]), F.lit(False))
        pushed = F.concat(acc["open"], F.array(F.struct(after.alias("at"), is_box.alias("box"))))
        popped = F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0)))
        return F.struct(
            after.alias("pos"),
            F.when(opens, pushed).when(closes, popped).otherwise(acc["open"]).alias("open"),
            F.when(better, top["at"]).otherwise(acc["lo"]).alias("lo"),
            F.when(better, acc["pos"]).otherwise(acc["hi"]).alias("hi"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["lo"] >= 0, F.substring(text, acc["lo"] + 1, acc["hi"] - acc["lo"]))

    return F.aggregate(tokens, start, step, finish)


def last_boxed(text: Column) -> Column:
    """Contents of the last balanced ``\\boxed{...}``; null when there is none."""
    found = F.when(text.rlike(OPEN_CASE), _last_box_by_stack(text)).otherwise(last_match(text, FLAT_BOX))
    return F.when(text.contains("\\boxed"), found)


_PLAIN_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)\z"
_FRACTION = r"^([+-]?)(?:\\[dt]?frac\{(-?\d+)\}\{(-?\d+)\}|(\d+)/(-?\d+))\z"


def simple_value(expr: Column) -> Column:
    """Value of a plain number or a simple fraction, else null."""
    part = lambda groups: F.regexp_replace(expr, _FRACTION, groups).try_cast("double")
    sign = F.when(expr.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    ratio = F.try_divide(sign * part("$2$4"), part("$3$5"))
    fraction = (expr.contains("/") | expr.contains("frac")) & expr.rlike(_FRACTION)
    return F.when(expr.rlike(_PLAIN_NUMBER), expr.try_cast("double")).when(fraction, ratio)


def _squashed(v: Mapping[str, Column]) -> dict[str, Column]:
    return {"a": squash(v["answer"]), "b": squash(v["target"])}


def _values_if_unlike(v: Mapping[str, Column]) -> dict[str, Column]:
    unlike = v["a"] != v["b"]
    return {"x": F.when(unlike, simple_value(v["a"])), "y": F.when(unlike, simple_value(v["b"]))}


def _same(v: Mapping[str, Column]) -> Column:
    return F.coalesce((v["a"] == v["b"]) | is_close(v["x"], v["y"]), F.lit(False))


#: Equal once white space is gone, or equal as plain numbers / simple fractions.
same_expression = Steps(_squashed, _values_if_unlike, _same, inputs=("answer", "target"))


def boxed_reason(answer: Column, truth: Column) -> Column:
    """Reason code for an extracted box ``answer`` and a reference expression ``truth``."""
    return (
        F.when(answer.isNull(), "no_boxed")
        .when(F.coalesce(truth, F.lit("")) == "", "empty_gt")
        .when(same_expression(answer, truth), "correct")
        .otherwise("incorrect")
    )


def boxed_truth(truth: Column) -> Column:
    return F.coalesce(last_boxed(truth), strip(truth))


def _boxed_match(v: Mapping[str, Column]) -> Column:
    """``boxed_reason`` is "correct"."""
    return (v["answer"].isNotNull() & (F.coalesce(v["target"], F.lit("")) != "") & _same(v)).cast("double")


boxed_utility = Steps(
    lambda v: {"answer": last_boxed(v["text"]), "target": boxed_truth(v["truth"])}, _squashed, _values_if_unlike, _boxed_match)
#: Boxed answer against a reference that is never boxed itself.
stripped_truth_utility = Steps(
    lambda v: {"answer": last_boxed(v["text"]), "target": strip(v["truth"])}, _squashed, _values_if_unlike, _boxed_match)


# --- answers by the shape of the target ------------------------------------

#: All up to the end of the last trigger, match after match from the start on.
_UP_TO_TRIGGER = r"\G(?is:.*?)" + TRIGGER
_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
#: A text in whole, its last line with content as the group.
_LAST_LINE = rf"(?s)\A(?:.*[{_BREAKS}])?([^{_BREAKS}]*?[^\s{_BREAKS}][^{_BREAKS}]*).*\z"


def _after_trigger(v: Mapping[str, Column]) -> dict[str, Column]:
    """The text after its last answer trigger, or all of it."""
    text = v["text"]
    return {"tail": F.when(F.lower(text).contains("answer"), F.regexp_replace(text, _UP_TO_TRIGGER, "")).otherwise(text)}


def _span(v: Mapping[str, Column]) -> Column:
    text, tail = v["text"], v["tail"]
    last_line = F.regexp_replace(text, _LAST_LINE, "$1")
    return F.substring(F.when(F.length(tail) < F.length(text), tail).otherwise(last_line), 1, SPAN_CHARS)


#: Text after the last answer trigger, else the last line with content, cut to a window.
final_span = Steps(_after_trigger, _span, inputs=("text",))


def token_norm(text: Column) -> Column:
    return F.lower(F.btrim(strip(text), F.lit(TOKEN_EDGES)))


def choice_letter(span: Column, text: Column) -> Column:
    places = ((span, PAREN_LETTER), (text, PAREN_LETTER), (span, LONE_LETTER))
    found = F
    for where, pattern in places:
        found = found.when(where.rlike(pattern), F.lower(F.regexp_extract(where, pattern, 1)))
    return found


def _plain_integer(token: Column) -> Column:
    """Integer text without leading zeros, of any length."""
    digits = F.regexp_replace(token, r"^(-?)0*(\d)", "$1$2")
    return F.regexp_replace(digits, r"^-0\z", "0")


def _contains_word(span: Column, word: Column) -> Column:
    """The word stands in the span, no letter beside it. Its pattern is compiled for spans that hold its text only."""
    quoted = F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    apart = F.regexp_like(F.lower(span), F.concat(F.lit("(?<![a-z])\\Q"), quoted, F.lit("\\E(?![a-z])")))
    return F.contains(F.lower(span), word) & apart


def _shape(v: Mapping[str, Column]) -> dict[str, Column]:
    target = v["target"]
    kind = (
        F.when(target == "", "none").when(target.rlike(f"^{PAREN_LETTER}\\z"), "letter").when(target.rlike(f"^{INTEGER}\\z"), "count")
        .otherwise("token")
    )
    return {"kind": kind, "gold": token_norm(target)}


def _shape_hit(v: Mapping[str, Column]) -> Column:
    span, text, target, kind, gold = (v[n] for n in ("span", "text", "target", "kind", "gold"))
    counted = F.coalesce(last_match(span, INTEGER, 0), last_match(text, INTEGER, 0))
    hit = (
        F.when(kind == "none", False)
        .when(kind == "letter", choice_letter(span, text) == F.lower(F.regexp_extract(target, PAREN_LETTER, 1)))
        .when(kind == "count", _plain_integer(counted) == _plain_integer(target))
        .otherwise((gold != "") & ((token_norm(span) == gold) | _contains_word(span, gold)))
    )
    return F.coalesce(hit, F.lit(False)).cast("double")


#: 1.0 when the committed answer meets the target, read by the target's own shape.
shape_match = Steps(_shape, _shape_hit, inputs=("span", "text", "target"))
shape_utility = Steps(
    lambda v: {**_after_trigger(v), "target": strip(v["truth"])},
    lambda v: {"span": _span(v), **_shape(v)},
    _shape_hit,
)


# --- code answers ----------------------------------------------------------

def strip_fence(text: Column) -> Column:
    """Body of the first code fence, else the whole text."""
    return F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)


def starter_method(starter: Column) -> Column:
    return F.nullif(F.regexp_extract(starter, METHOD, 1), F.lit(""))


def stdout_match(returncode: Column, stdout: Column, expected: Column) -> Column:
    return F.coalesce((returncode == 0) & (rstrip(stdout) == rstrip(expected)), F.lit(False))


def strict_json(text: Column) -> Column:
    """The text as one JSON value, null when it is not. Inside an object, trailing text is an error too."""
    return F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))


#: Tokens of printed JSON: strings, numbers and words, punctuation.
JSON_TOKEN = r'"(?:[^"\\]|\\.)*+"|[-+.0-9A-Za-z]+|[\[\]{}:,]'


def _typed_token(token: Column) -> Column:
    """A token as the value it stands for: true is 1, numbers that are equal print alike, strings stay."""
    number = token.try_cast("double")
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), number.try_cast("bigint").cast("string"))
    typed = (
        F.when(token == "true", "1").when(token == "false", "0")
        .when(token.rlike(r"^-?\d+\z"), F.when(token == "-0", "0").otherwise(token))
        .when(token.rlike(r"^-?\d"), F.coalesce(whole, number.cast("string")))
    )
    return F.when(F.substring(token, 1, 1) == '"', token).otherwise(F.coalesce(typed, token))


def json_tokens(printed: Column) -> Column:
    """Typed tokens of a value printed by ``to_json``, which sorts keys and has one way to print a string. Equal values give equal arrays."""
    return F.transform(F.regexp_extract_all(printed, F.lit(JSON_TOKEN), F.lit(0)), _typed_token)


def json_match(returncode: Column, stdout: Column, expected: Column) -> Column:
    """Equal as JSON values, or as stripped text when a side is not JSON.

    Values are compared by type: numbers by value (1, 1.0, 1e0 and true are equal), objects by key, arrays in order. Whole numbers beyond 38 digits
    count as doubles; repeated keys and NaN are not JSON here.
    """
    as_json = lambda text: F.to_json(strict_json(text))
    sides = F.struct(strip(stdout).alias("got"), strip(expected).alias("want"))
    parsed = lambda v: F.struct(as_json(v["got"]).alias("got"), as_json(v["want"]).alias("want"))
    equal = lambda j: F.coalesce((j["got"] == j["want"]) | (json_tokens(j["got"]) == json_tokens(j["want"])), F.lit(False))
    same = let(sides, lambda v: (v["got"] == v["want"]) | let(parsed(v), equal))
    return F.coalesce((returncode == 0) & same, F.lit(False))
