"""Rules on texts, as Columns: a rule is a condition and the word it points at; all rules of a file are one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T


@dataclass(frozen=True)
class TextRule:
    """``when`` says on the text's Column whether the rule holds; ``anchor`` is the word whose place is reported."""

    rule_id: str
    severity: int
    anchor: str
    conditions: tuple = field(default=())

    def when(self, condition) -> TextRule:
        return TextRule(self.rule_id, self.severity, self.anchor, (*self.conditions, condition))

    def unless(self, condition) -> TextRule:
        return self.when(lambda text: ~condition(text))

    def holds(self, text: Column) -> Column:
        out = F.lit(True)
        for condition in self.conditions:
            out = out & condition(text)
        return out


def contains(*words: str):
    """The text has one of the words."""

    def condition(text: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | text.contains(w)
        return out

    return condition


def matches(*patterns: str):
    """The text matches one of the regular expressions."""

    def condition(text: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | text.rlike(p)
        return out

    return condition


#: Patterns of markup that runs code, and of personal or secret content.
XSS_PATTERNS = (r"(?i)<script\b[^>]*>(.*?)</script>", r"(?i)javascript\s*:", r"(?i)on\w+\s*=\s*[\"']?[^\"']*[\"']?", r"(?i)eval\s*\(", r"(?i)expression\s*\(")
SENSITIVE_PATTERNS = (r"(?i)password", r"(?i)passwd", r"(?i)token", r"(?i)api[-_]?key", r"(?i)secret", r"(?i)credential", r"\d{13,16}", r"\b[\w.%+-]+@[\w.-]+\.[a-zA-Z]{2,}\b")
#: APIs that are dangerous, with the severity of their use.
DANGEROUS_APIS = (("eval", "critical"), ("document.write", "high"), ("innerHTML", "high"), ("localStorage.setItem", "medium"), ("sessionStorage.setItem", "medium"), ("fetch", "medium"), ("XMLHttpRequest.open", "medium"), ("setTimeout", "medium"), ("setInterval", "medium"), ("Function", "critical"))

STATIC_RULES = (
    TextRule("security/no-unsafe-innerHTML", 3, "innerHTML").when(contains("innerHTML", "dangerouslySetInnerHTML")),
    TextRule("security/no-eval", 3, "eval(").when(contains("eval(", "new Function(")),
    TextRule("memory/no-forgotten-listeners", 2, "addEventListener").when(contains("addEventListener")).unless(contains("removeEventListener")),
)
EDITOR_RULES = (
    TextRule("editor/xss", 3, "innerHTML").when(contains("innerHTML", "dangerouslySetInnerHTML", "document.write")),
    TextRule("editor/listener-leak", 2, "addEventListener").when(contains("addEventListener")).unless(contains("removeEventListener")),
)
BUILD_RULES = (
    TextRule("XSS-001", 2, "innerHTML").when(contains("innerHTML")),
    TextRule("EVAL-001", 3, "eval(").when(contains("eval(")),
)
NODE_TEXT_RULES = (
    TextRule("security/xss/dangerous-html", 3, "dangerouslySetInnerHTML").when(contains("dangerouslySetInnerHTML")).unless(matches(r"(?i)sanitize|DOMPurify")),
    TextRule("security/csrf/missing-token", 2, "<form").when(matches(r"<form\b")).unless(matches(r"(?i)csrf|_token|xsrf")),
    TextRule("security/injection/sql-injection", 3, "SELECT").when(matches(r"(?i)\b(select|insert|update|delete)\b[^;\n]*(\"|'|`)\s*\+", r"(?i)`[^`\n]*\b(select|insert|update|delete)\b[^`\n]*\$\{")),
    TextRule("security/script-injection", 3, "createElement").when(matches(r"createElement\(\s*['\"]script['\"]", r"\.src\s*=\s*[^'\"\n]*\+")),
    TextRule("security/sensitive-data-exposure", 2, "localStorage").when(matches(r"(?i)(localStorage|sessionStorage)\.setItem\([^)]*(password|token|secret|key)")),
    TextRule("security/url/unsafe-redirect", 2, "location").when(matches(r"(window\.)?location(\.href)?\s*=\s*[^'\"\s;]", r"location\.(assign|replace)\(\s*[^'\")]")),
    TextRule("memory/leak/react-useeffect-cleanup", 2, "useEffect").when(matches(r"useEffect\(\(\) => \{[\s\S]*?(addEventListener|setInterval|setTimeout)\(")).unless(matches(r"return \(\) =>")),
    TextRule("performance/large-dependency-import", 1, "import").when(matches(r"from ['\"](lodash|moment|rxjs|jquery|@material-ui/core)['\"]")),
    TextRule("critical/csrf/insecure-cors", 2, "Access-Control-Allow-Origin").when(matches(r"Access-Control-Allow-Origin['\"]?\s*[:,]\s*['\"]\*")),
    TextRule("react/hooks/conditional-hook", 2, "use").when(matches(r"\bif \([^)]*\) \{\s*\n?\s*(const \[[^\]]*\] = )?use[A-Z]\w*\(")),
)


def findings(files: DataFrame, rules: Sequence[TextRule], *, id_col: str = "file_id", text_col: str = "source_code") -> DataFrame:
    """(id, rule_id, severity, line_no, column_no, snippet): every rule that holds, at the first place of its word, else at 1:1.

    One scan: all rules into an array, one explode.  Null texts have no findings.
    """
    text = F.col(text_col)
    hits = []
    for r in rules:
        at = T.position(text, r.anchor)
        place = F.struct(
            F.lit(r.rule_id).alias("rule_id"),
            F.lit(r.severity).alias("severity"),
            F.when(at > 0, T.line_at(text, at)).otherwise(1).alias("line_no"),
            F.when(at > 0, T.column_at(text, at)).otherwise(1).alias("column_no"),
            F.when(at > 0, T.snippet(text, at, F.lit(len(r.anchor)))).otherwise("").alias("snippet"),
        )
        hits.append(F.when(r.holds(text), place))
    return files.filter(text.isNotNull()).select(id_col, F.explode(F.array_compact(F.array(*hits))).alias("h")).select(id_col, "h.*")


def imports(files: DataFrame) -> DataFrame:
    """(file_id, no, source, local): import lines of a script in their order."""
    line = files.filter("source_code is not null").select("file_id", F.posexplode(F.split("source_code", r"\r?\n")).alias("no", "line")).filter(F.col("line").startswith("import "))
    return line.select("file_id", "no", F.regexp_extract("line", r"['\"]([^'\"]+)['\"];?\s*$", 1).alias("source"), F.trim(F.regexp_extract("line", r"^import\s+(.*?)\s+from\b", 1)).alias("local")).filter("source <> ''")


def duplicate_imports(found: DataFrame) -> DataFrame:
    """Sources that a file imports more than once."""
    return found.groupBy("file_id", "source").agg(F.count("*").alias("times"), F.min("no").alias("first_line")).filter("times > 1")


def imports_of(found: DataFrame, libraries: DataFrame) -> DataFrame:
    """Imports of a library or of something below it, as an equi-join on the source's folders; libraries has library, kb."""
    parts = F.split("source", "/")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    return found.select("*", prefixes.alias("library")).join(libraries, "library")


def unused_imports(files: DataFrame) -> DataFrame:
    """(file_id, source, name): default and namespace imports whose name does not occur again in the file.

    Each file is looked at by itself; its text travels nowhere.
    """
    lines = F.filter(F.split("source_code", r"\r?\n"), lambda x: x.startswith("import "))
    named = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"['\"]([^'\"]+)['\"];?\s*$", 1).alias("source"), F.regexp_extract(x, r"(\w+)\s+from\b", 1).alias("name")))
    uses = lambda name: F.size(F.regexp_extract_all("source_code", F.concat(F.lit(r"\b"), name, F.lit(r"\b")), F.lit(0)))
    unused = F.filter(named, lambda i: (i["source"] != "") & (i["name"] != "") & (uses(i["name"]) <= 1))
    return files.filter("source_code is not null").select("file_id", F.explode(unused).alias("i")).select("file_id", "i.*")
