"""Rule base: categories, their patterns, and the match expressions built from them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import fixed_rules
from palisade.options import Options
from palisade.session import once

# Java flags that make a pattern behave as a case-insensitive Unicode search in
# which only "\n" ends a line.  On ASCII text the shorter flags find the same, at
# a fraction of the cost.
FLAGS, ASCII_FLAGS = "(?diuU)", "(?di)"


@dataclass(frozen=True)
class Category:
    """One detector category: what it searches and what a hit is worth."""

    code: str
    yaml_key: str
    reason: str
    score_field: str
    on_path: bool = False
    on_raw: bool = False
    on_agent: bool = False
    literal: bool = False


# The categories in detection order, with their reason texts.
CATEGORIES = (
    Category("sensitive_path", "sensitive_paths", "敏感路径扫描", "sensitive_path", on_path=True, literal=True),
    Category("sql_injection", "sql_injection_patterns", "SQL注入特征", "sql_injection", True, True),
    Category("xss", "xss_patterns", "XSS攻击特征", "sql_injection", True, True),
    Category("path_traversal", "path_traversal_patterns", "路径遍历攻击", "sql_injection", True),
    Category("command_injection", "command_injection_patterns", "命令注入特征", "sql_injection", True, True),
    Category("file_inclusion", "file_inclusion_patterns", "文件包含攻击", "sql_injection", True, True),
    Category("ssrf", "ssrf_patterns", "SSRF攻击特征", "sql_injection", True, True),
    Category("xxe", "xxe_patterns", "XXE攻击特征", "sql_injection", False, True),
    Category("ssti", "ssti_patterns", "模板注入特征", "sql_injection", True, True),
    Category(
        "java_deserialization", "java_deserialization_patterns", "Java反序列化攻击", "sql_injection", False, True
    ),
    Category("malicious_ua", "malicious_ua_patterns", "恶意UA", "malicious_ua", on_agent=True),
)
BY_CODE = {c.code: c for c in CATEGORIES}
REQUEST_CATEGORIES = tuple(c.code for c in CATEGORIES if not c.literal and not c.on_agent)


def _lines(text: str) -> tuple[str, ...]:
    return tuple(text.strip("\n").split("\n"))


def _default_patterns() -> dict[str, tuple[str, ...]]:
    return {
        "sensitive_path": _lines(fixed_rules.SENSITIVE_PATHS),
        "sql_injection": _lines(fixed_rules.SQL_INJECTION),
        "xss": _lines(fixed_rules.XSS),
        "path_traversal": _lines(fixed_rules.PATH_TRAVERSAL),
        "command_injection": _lines(fixed_rules.COMMAND_INJECTION),
        "file_inclusion": _lines(fixed_rules.FILE_INCLUSION),
        "ssrf": _lines(fixed_rules.SSRF),
        "xxe": _lines(fixed_rules.XXE),
        "ssti": _lines(fixed_rules.SSTI),
        "java_deserialization": _lines(fixed_rules.JAVA_DESERIALIZATION),
        "malicious_ua": _lines(fixed_rules.MALICIOUS_UA),
    }


def sql_text(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def searchable(records: DataFrame, codes: Iterable[str] | None = None) -> DataFrame:
    """Add what the match expressions need: the lower-cased path, and an ASCII mark.

    Only columns the given categories search are read.
    """
    chosen = [BY_CODE[c] for c in (BY_CODE if codes is None else codes)]
    searched = {"path": True, "raw": any(c.on_raw for c in chosen), "user_agent": any(c.on_agent for c in chosen)}
    plain = " and ".join(f"octet_length({c}) = char_length({c})" for c, used in searched.items() if used)
    return once(records, {"_path": F.lower("path"), "_ascii": F.expr(plain)})


def is_usable(pattern: str) -> bool:
    """Patterns that do not compile are left out of a category, silently."""
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def minimal_literals(literals: Iterable[str]) -> list[str]:
    """Literals that contain no other literal: enough to answer "does any occur?"."""
    lowered = list(dict.fromkeys(x.lower() for x in literals))
    return [x for x in lowered if not any(y != x and y in x for y in lowered)]


GROUP = 4  # branches behind one look at the next character
_META = set(".^$*+?{}[]()|\\")


def _literal_start(pattern: str) -> tuple[tuple[str, ...], str]:
    """Leading literal characters of a pattern, and what follows them."""
    tokens: list[str] = []
    i = 0
    while i < len(pattern):
        width = 2 if pattern[i] == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum() else 1
        token, after = pattern[i : i + width], pattern[i + width : i + width + 1]
        if (width == 1 and token in _META) or (after and after in "*+?{"):
            break
        tokens.append(token.lower())
        i += width
    return tuple(tokens), pattern[i:]


def any_of(patterns: Iterable[str]) -> str:
    """Alternation of patterns with common literal beginnings written once.

    A search tries every branch at every position, so one branch per first
    character costs a fraction of one branch per rule.  It finds the same texts.
    """
    split = [((), p) if re.search(r"(?<!\\)\|", p) else _literal_start(p) for p in dict.fromkeys(patterns)]

    def guarded(heads: list[str], parts: list[str]) -> list[str]:
        chunks = range(0, len(parts), GROUP)
        heads = [h if len(h) > 1 else re.escape(h) for h in heads]
        return [f"(?=[{''.join(heads[i:i + GROUP])}])(?:{'|'.join(parts[i:i + GROUP])})" for i in chunks]

    def alternation(items: list[tuple[tuple[str, ...], str]]) -> str:
        branches: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        ends = []
        for tokens, rest in items:
            if tokens:
                branches.setdefault(tokens[0], []).append((tokens[1:], rest))
            else:
                ends.append(rest)
        if "" in ends:  # a rule ends here: whatever would follow is found as well
            return ""
        parts = [head + alternation(tail) for head, tail in branches.items()]
        if len(parts) > 2 * GROUP:
            parts = guarded(list(branches), parts)
        parts += ends
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return alternation(split)


@dataclass(frozen=True)
class Rulebook:
    patterns: Mapping[str, tuple[str, ...]] = field(default_factory=_default_patterns)

    @classmethod
    def from_dict(cls, lists: Mapping[str, Iterable[str]]) -> "Rulebook":
        return cls({c.code: tuple(str(x) for x in (lists.get(c.yaml_key) or ())) for c in CATEGORIES})

    @classmethod
    def from_yaml(cls, path: str) -> "Rulebook":
        import yaml

        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(yaml.safe_load(handle) or {})

    def numbered(self, code: str) -> list[tuple[int, str]]:
        """Usable patterns with their position in the list."""
        rules = enumerate(self.patterns.get(code, ()))
        return [(i, p) for i, p in rules if BY_CODE[code].literal or is_usable(p)]

    def search(self, code: str) -> str | None:
        """One pattern that finds any rule of the category."""
        if BY_CODE[code].literal:
            rules = [re.escape(x) for x in minimal_literals(self.patterns.get(code, ()))]
        else:
            rules = [p for _, p in self.numbered(code)]
        return any_of(rules) if rules else None

    def _texts(self, code: str) -> list[str]:
        category = BY_CODE[code]
        texts = ["_path"] if category.on_path else []
        texts += ["raw"] if category.on_raw else []
        return texts + (["user_agent"] if category.on_agent else [])

    def matches_sql(self, code: str) -> str:
        """SQL text of "any rule of the category matches"; needs ``searchable`` records."""
        pattern = self.search(code)
        if pattern is None:
            return "false"

        def hit(flags: str) -> str:
            # The longest text first: a hit in the raw line saves the search of its path.
            return " or ".join(f"{text} rlike {sql_text(flags + pattern)}" for text in reversed(self._texts(code)))

        applies = "user_agent" if BY_CODE[code].on_agent else "path"
        return f"({applies} <> '' and case when _ascii then {hit(ASCII_FLAGS)} else {hit(FLAGS)} end)"

    def matches(self, code: str) -> Column:
        return F.expr(self.matches_sql(code))

    def _first_sql(self, code: str, result: Callable[[int, str], str]) -> str:
        """SQL text of a CASE over the rules in order.

        Every pattern is a literal, compiled once per task, and the branches stop at
        the first match.  Guard it with ``matches``, so that only records the single
        alternation has found pay for it.
        """
        branches = []
        for number, pattern in self.numbered(code):
            rule = sql_text(FLAGS + (re.escape(pattern.lower()) if BY_CODE[code].literal else pattern))
            hit = " or ".join(f"{text} rlike {rule}" for text in self._texts(code))
            branches.append(f"when {hit} then {result(number, pattern)}")
        return f"case {' '.join(branches)} end" if branches else "null"

    def first_pattern_sql(self, code: str) -> str:
        """SQL text of the first rule that matches."""
        return self._first_sql(code, lambda number, pattern: sql_text(pattern))

    def first_rule(self, code: str) -> Column:
        """Position of the first rule that matches, else NULL."""
        return F.expr(self._first_sql(code, lambda number, pattern: str(number))).cast("int")

    def frame(self, spark: SparkSession, options: Options = Options()) -> DataFrame:
        """The rule base as a table."""
        rows = [
            (c.code, i, p, c.on_path, c.on_raw, c.on_agent, c.reason, getattr(options.scores, c.score_field))
            for c in CATEGORIES
            for i, p in self.numbered(c.code)
        ]
        schema = (
            "category string, rule_no int, pattern string, on_path boolean, on_raw boolean, "
            "on_ua boolean, reason string, score int"
        )
        return spark.createDataFrame(rows, schema)
