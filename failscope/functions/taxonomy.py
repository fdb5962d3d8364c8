"""The ten failure categories: names, numbers, and rules from free text to both."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INCONCLUSIVE = 10

#: Number, name and description of each category.
CASES = (
    (1, "Instruction Adherence Failure", "The agent did not follow an explicit instruction, domain policy, or its own stated plan."),
    (2, "Invention of New Information", "The agent asserted a fact, value, or identifier that was never provided or returned."),
    (3, "Invalid Invocation", "The agent called a tool that does not exist, or with missing/malformed/wrong arguments."),
    (4, "Misinterpretation of Tool Output", "The agent misread a tool result -- miscounted, misparsed, or drew a wrong conclusion."),
    (5, "Intent Plan Misalignment", "The agent's plan does not serve the user's actual intent, even if executed faithfully."),
    (6, "Underspecified User Intent", "The user's request was ambiguous and the agent proceeded without resolving it."),
    (7, "Intent Not Supported", "The request is outside what the available tools or policy can accomplish."),
    (8, "Guardrails Triggered", "A safety, permission, or policy guardrail blocked progress."),
    (9, "System Failure", "Infrastructure-level breakage: crash, timeout, unavailable service, truncated context."),
    (10, "Inconclusive", "No category is adequately supported by the evidence."),
)
NAMES = {case: name for case, name, _ in CASES}
#: Fixed value: the one constant name that isn't a category's name in capitals.
EXTRA_CONSTANTS = {"INSTRUCTION_PLAN_ADHERENCE_FAILURE": 1}


def dimension(spark: SparkSession) -> DataFrame:
    """The categories as a table of ten rows."""
    return spark.createDataFrame(CASES, "case int, category string, description string")


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def normalize_category(c: Column) -> Column:
    """Free text -> category name. The order of the rules decides; null and empty texts are
    ``Unknown``, a text that no rule knows stays, trimmed."""
    low = F.lower(F.trim(c))
    has = lambda *words: [low.contains(w) for w in words]
    both = lambda *words: F.lit(True) if not words else has(*words)[0] if len(words) == 1 else has(words[0])[0] & both(*words[1:])
    rules = (
        (both("instruction", "adherence"), 1),
        (both("invention") | both("new", "information"), 2),
        (both("invalid", "invocation"), 3),
        (both("misinterpretation") | both("handoff"), 4),
        (both("intent") & (both("plan") | both("misalignment")), 5),
        (both("underspecified") | (both("user", "intent") & ~low.contains("not")), 6),
        (both("not supported") | both("intent", "not", "supported"), 7),
        (both("guardrail"), 8),
        (both("system", "failure"), 9),
        (both("inconclusive"), 10),
    )
    out = F.when(c.isNull() | (c == ""), F.lit("Unknown"))
    for rule, case in rules:
        out = out.when(rule, F.lit(NAMES[case]))
    return out.otherwise(F.trim(c))


def failure_case(c: Column) -> Column:
    """Digits from 1 to 10, or a category's constant name (what follows its last dot) -> number, else 10."""
    text = F.trim(c)
    number = F.try_to_number(F.when(text.rlike(r"^[0-9]{1,9}$"), text), F.lit("999999999")).cast("int")
    constants = {name.upper().replace(" ", "_"): case for case, name in NAMES.items()} | EXTRA_CONSTANTS
    constant = F.regexp_replace(F.upper(F.element_at(F.split(text, r"\."), -1)), "[ -]", "_")
    named = F.try_element_at(_lookup(constants), constant)
    return F.when(text.rlike(r"^[0-9]+$"), F.when(number.between(1, 10), number).otherwise(F.lit(INCONCLUSIVE))).otherwise(F.coalesce(named, F.lit(INCONCLUSIVE)))


def category_case(c: Column) -> Column:
    """Free text -> number: by name rules first, then as :func:`failure_case`."""
    name = normalize_category(c)
    return F.coalesce(F.try_element_at(_lookup({v: k for k, v in NAMES.items()}), name), failure_case(name))


def case_category(c: Column) -> Column:
    """Number -> name; other numbers are ``Inconclusive``."""
    return F.coalesce(F.try_element_at(_lookup(NAMES), c.cast("int")), F.lit(NAMES[INCONCLUSIVE]))


def checklist() -> str:
    """The taxonomy as prompt text."""
    return "\n".join(f"{case}. {name} — {description}" for case, name, description in CASES)
