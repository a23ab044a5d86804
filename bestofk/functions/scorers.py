"""Registries of scoring rules and answer keys, by dataset name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bestofk.functions import text as T

Scorer = Callable[[Column, Column], Column]

_SCORERS: dict[str, Scorer] = {
    "gsm8k": T.numeric_utility,
    "math": T.boxed_utility,
    "matharena": T.stripped_truth_utility,
    "bbh": T.shape_utility,
}

_KEYS: dict[str, Callable[[Column], Column]] = {
    "gsm8k": lambda text: (T.number_in(text) + F.lit(0.0)).cast("string"),
    "math": lambda text: T.squash(T.last_boxed(text)),
    "matharena": lambda text: T.squash(T.last_boxed(text)),
}


#: Datasets whose answers are programs: judged by recorded test runs, not by their text.
CODE_DATASETS = ("humaneval", "livecodebench")


#: Names whose scorer runs Python.
_PYTHON: set[str] = set()


def register_scorer(name: str, scorer: Scorer, python: bool | None = None) -> None:
    """Add a scorer: a function of the (answer, reference) columns giving a double column.

    Wrap vectorised Python in ``pandas_udf('double')`` where no column expression exists; say ``python=True`` where the function only
    calls such a wrapped one. Python scorers get a table of their own rows (``experiments.score_samples``).
    """
    key = name.strip().lower()
    _SCORERS[key] = scorer
    runs_python = hasattr(scorer, "evalType") if python is None else python
    (_PYTHON.add if runs_python else _PYTHON.discard)(key)


def unregister_scorer(name: str) -> None:
    _SCORERS.pop(name.strip().lower(), None)
    _PYTHON.discard(name.strip().lower())


def known_datasets() -> tuple[str, ...]:
    return tuple(sorted({*_SCORERS, *CODE_DATASETS}))


def get_scorer(name: str) -> Scorer:
    key = name.strip().lower()
    if key not in _SCORERS:
        raise KeyError(f"no scorer for dataset {name!r}; known: {', '.join(known_datasets())}")
    return _SCORERS[key]


def supports_answer_key(name: str) -> bool:
    return name.strip().lower() in _KEYS


def answer_key(name: str, text: Column) -> Column:
    """Vote key of an answer: equal keys mean agreeing answers, null means no answer."""
    key = name.strip().lower()
    if key not in _KEYS:
        raise KeyError(f"no answer key for dataset {name!r}; known: {', '.join(sorted(_KEYS))}")
    return _KEYS[key](text)


def dataset_key(dataset: Column) -> Column:
    """The name by which rules are registered: without outer white space, in lower case."""
    return F.lower(T.strip(dataset))


def _dispatch(name: Column, branches: dict[str, Column], what: str) -> Column:
    """One CASE per registered name, which ``name`` holds; unknown names fail."""
    known = ", ".join(sorted(branches))
    chain = None
    for key, value in branches.items():
        chain = F.when(name == key, value) if chain is None else chain.when(name == key, value)
    unknown = F.raise_error(F.concat(F.lit(f"no {what} for dataset "), F.coalesce(name, F.lit("null")), F.lit(f"; known: {known}")))
    return unknown if chain is None else chain.otherwise(unknown)


def registered() -> tuple[str, ...]:
    return tuple(sorted(_SCORERS))


def python_scorers() -> dict[str, Scorer]:
    return {name: _SCORERS[name] for name in sorted(_PYTHON)}


def _without_outcomes() -> dict[str, Column]:
    refused = F.raise_error(F.lit("programs are scored from recorded test runs: pass outcomes")).cast("double")
    return {n: refused for n in CODE_DATASETS}


def native_scores(df: DataFrame, name: str, text: str, truth: str, utility: str) -> DataFrame:
    """Add the utility by the column-expression rule of column ``name``, a key of ``dataset_key``; unknown names fail.

    Rules in steps (``text.Steps``) get a projection for each step, in which a row evaluates its own rule's values only. The values of
    rules share columns by name, and a step that several rules have is there once.
    """
    rules = {n: s.steps if isinstance(s, T.Steps) else (_one_step(s),) for n, s in _SCORERS.items() if n not in _PYTHON}
    number = F
    for i, n in enumerate(rules):
        number = number.when(F.col(name) == n, i)
    rule, added = F.col("__rule"), ["__rule"]
    df = df.withColumn("__rule", number if rules else F.lit(None))
    known = {n: {"text": text, "truth": truth} for n in rules}

    def chosen(depth: int, last: bool) -> dict[str, Column]:
        """The values of this step, each by rule."""
        users: dict[tuple, list[str]] = {}
        for n, steps in rules.items():
            if (depth == len(steps) - 1) == last and depth < len(steps):
                users.setdefault((steps[depth], *known[n].items()), []).append(n)
        values: dict[str, Column] = {}
        for (step, *columns), names in users.items():
            made = step({value: F.col(column) for value, column in columns})
            own = rule.isin([i for i, n in enumerate(rules) if n in names])
            for value, result in (made if isinstance(made, Mapping) else {"": made}).items():
                values[value] = values.get(value, F).when(own, result)
                for n in names:
                    known[n] = known[n] | {value: f"__{depth}_{value}"}
        return {f"__{depth}_{value}": column for value, column in values.items()}

    results = []
    for depth in range(max(map(len, rules.values()), default=0)):
        ends, between = chosen(depth, True), chosen(depth, False)
        df, added, results = df.withColumns(ends | between), [*added, *ends, *between], [*results, *ends]
    branches = _without_outcomes() | {n: F.lit(None).cast("double") for n in rules}
    unscored = F.when(rule.isNull(), _dispatch(F.col(name), branches, "scorer"))
    return df.withColumn(utility, F.coalesce(unscored, *[F.col(c) for c in results])).drop(*added)


def _one_step(scorer: Scorer) -> T.Step:
    return lambda v: scorer(v["text"], v["truth"])


def score_dispatch(dataset: Column, text: Column, truth: Column, tests_passed: Column | None = None) -> Column:
    """Utility by the rule of the row's dataset; ``tests_passed`` is the verdict on a program's recorded test runs.

    A row evaluates its own column expression only. Spark runs Python ahead of the projection, for every row, so a Python scorer sees all
    rows of the table here; ``experiments.score_samples`` gives each of them a table of its own.
    """
    rules = {n: s(text, truth) for n, s in _SCORERS.items()}
    verdicts = _without_outcomes() if tests_passed is None else {n: tests_passed for n in CODE_DATASETS}
    return _dispatch(dataset_key(dataset), verdicts | rules, "scorer")


def named_key(name: Column, text: Column) -> Column:
    """Vote key by the rule of ``name``, a key of ``dataset_key``."""
    return _dispatch(name, {n: k(text) for n, k in _KEYS.items()}, "answer key")


def key_dispatch(dataset: Column, text: Column) -> Column:
    return named_key(dataset_key(dataset), text)
