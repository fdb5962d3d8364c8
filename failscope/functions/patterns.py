"""Patterns of the signals. Results depend on every alternative.

``(?iuUd)`` gives Java what the definitions assume: case folding and classes over all of Unicode, and
a dot that stops at line feeds only.
"""

_FLAGS = "(?iuUd)"

TOOL_ERROR = _FLAGS + (
    r"^\s*(error|exception|traceback)\b"
    r"|\berror:\s"
    r"|\b(not found|does not exist|no such|invalid|unauthorized|forbidden|denied)\b"
    r"|\b(timed? ?out|timeout)\b"
    r"|\bcannot\b.*\b(find|locate|access)\b"
)
REFUSAL = _FLAGS + (
    r"\b(i (?:can(?:no|')t|am unable to|was unable to|cannot)"
    r"|unable to (?:complete|find|locate|access|determine|proceed|help)"
    r"|i (?:do not|don't) have (?:access|permission|the ability)"
    r"|i(?:'m| am) (?:sorry|afraid)[^.]{0,60}\b(?:can(?:no|')t|unable|not able)"
    r"|not (?:permitted|allowed|authorized)"
    r"|i (?:give up|could not complete))"
)
INCOMPLETE = _FLAGS + (
    r"\b(unfortunately|regrettably)\b"
    r"|\b(?:could|was) not (?:be )?(?:complete[d]?|finish(?:ed)?|resolve[d]?|found)\b"
    r"|\bno (?:results?|matches?|information) (?:were |was )?(?:found|available)\b"
    r"|\bfailed to\b"
    r"|\bgiving up\b"
)
LEAKED_ERROR = _FLAGS + (
    r"\btraceback \(most recent call last\)"
    r"|\bstack ?trace\b"
    r"|\b[A-Za-z]+(?:Error|Exception):"
    r"|\bstatus code [45]\d\d\b"
    r"|\bhttp [45]\d\d\b"
)
