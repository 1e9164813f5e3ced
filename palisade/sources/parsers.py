"""Line formats as column expressions over one text column.

A parser has two steps.  ``prepare`` names the costly part (one regular
expression or one JSON parse per line); ``entry`` builds the record struct from
the prepared columns, NULL when the line is not of this format.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.ip import strip
from palisade.functions.times import parse_timestamp
from palisade.session import once

# Line formats and the JSON keys of the firewall logs.
NGINX_LINE = (
    r'^(\S+)\s+-\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d+)\s+(\d+|-)\s+"([^"]*)"\s+"([^"]*)"'
)
SSH_LINE = (
    r"^(\w+\s+\d+\s+[\d:]+)\s+(\S+)\s+sshd\[\d+\]:\s+"
    r"(Failed password|Invalid user|Accepted password|Accepted publickey)"
    r".*?from\s+(\d+\.\d+\.\d+\.\d+)"
)
DOTTED_QUAD = r"(\d+\.\d+\.\d+\.\d+)"
HOST_HEADER = r"(?i)host:\s*([^\s\n]+)"
IP_KEYS = ("ip", "client_ip", "remote_addr")
PATH_KEYS = ("uri", "url", "path")
AGENT_KEYS = ("user_agent", "ua")
WAF_TIME_KEYS = ("time", "timestamp", "@timestamp")
FREE_WAF_TIME_KEYS = ("time", "timestamp")
WAF_KEYS = IP_KEYS + WAF_TIME_KEYS + PATH_KEYS + AGENT_KEYS + (
    "method", "status", "rule_id", "rule_name", "action", "attack_type",
)
FREE_WAF_KEYS = IP_KEYS + FREE_WAF_TIME_KEYS + PATH_KEYS + AGENT_KEYS + (
    "method", "rule_type", "type", "domain", "host",
)
RAW_REQUEST_LIMIT = 500

ENTRY_FIELDS = ("timestamp", "ip", "source", "method", "path", "status", "user_agent", "raw", "extra")


@dataclass(frozen=True)
class ParseContext:
    """What a line may lack: its time, its year and its zone."""

    now: Column
    year: Column
    zone: str = "UTC"

    @classmethod
    def current(cls, zone: str = "UTC") -> "ParseContext":
        return cls(F.current_timestamp(), F.year(F.current_timestamp()), zone)

    @classmethod
    def at(cls, when: str, zone: str = "UTC") -> "ParseContext":
        ts = F.lit(when).cast("timestamp")
        return cls(ts, F.year(ts), zone)

    def time(self, text: Column) -> Column:
        return F.coalesce(parse_timestamp(text, self.zone, self.year), self.now)


@dataclass(frozen=True)
class LineParser:
    name: str
    prepare: Callable[[Column], dict[str, Column]]
    entry: Callable[[Column, ParseContext], Column]


def record(
    timestamp: Column,
    ip: Column,
    source: str,
    method: Column,
    path: Column,
    status: Column,
    user_agent: Column,
    raw: Column,
    extra: dict[str, Column],
) -> Column:
    pairs = [x for key, value in extra.items() for x in (F.lit(key), value.cast("string"))]
    return F.struct(
        timestamp.alias("timestamp"),
        F.coalesce(ip, F.lit("")).alias("ip"),
        F.lit(source).alias("source"),
        F.coalesce(method, F.lit("")).alias("method"),
        F.coalesce(path, F.lit("")).alias("path"),
        F.coalesce(status.cast("int"), F.lit(0)).alias("status"),
        F.coalesce(user_agent, F.lit("")).alias("user_agent"),
        raw.alias("raw"),
        F.create_map(*pairs).alias("extra"),
    )


def first_filled(columns: list[Column]) -> Column:
    """First value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def regex_groups(line: Column, pattern: str, n: int) -> Column:
    """All groups of a pattern anchored at the start, from one match per line.

    The groups are joined by a control character and split again.  A line that
    itself holds that character takes one extraction per group instead.
    """
    mark = "\x01"
    joined = F.regexp_replace(line, f"(?s){pattern}.*$", mark.join(f"${i}" for i in range(1, n + 1)))
    each = F.when(line.rlike(pattern), F.array(*[F.regexp_extract(line, pattern, i) for i in range(1, n + 1)]))
    groups = F.when(line.contains(mark), each).otherwise(F.split(joined, mark))
    return F.when(F.size(groups) == n, groups)


def _json_object(line: Column, keys: tuple[str, ...]) -> Column:
    text = strip(line)
    schema = ", ".join(f"`{k}` string" for k in dict.fromkeys(keys)) + ", `_bad` string"
    options = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
    return F.when(text.startswith("{") & text.endswith("}"), F.from_json(text, schema, options))


def _json_array(line: Column) -> Column:
    text = strip(line)
    parsed = F.from_json(text, "array<string>", {"allowSingleQuotes": "false"})
    return F.when(text.startswith("[") & text.endswith("]"), parsed)


def _keys(parsed: str, names: tuple[str, ...]) -> list[Column]:
    return [F.col(parsed).getField(n) for n in names]


def _is_object(parsed: str) -> Column:
    return F.col(parsed).isNotNull() & F.col(parsed).getField("_bad").isNull()


# --- nginx ----------------------------------------------------------------------


def _nginx_prepare(line: Column) -> dict[str, Column]:
    return {"_nginx": regex_groups(strip(line), NGINX_LINE, 8)}


def _nginx_entry(line: Column, ctx: ParseContext) -> Column:
    ip, user, time, request, status, size, referer, agent = (F.col("_nginx")[i] for i in range(8))
    split = request.contains(" ")
    method = F.when(split, F.split_part(request, F.lit(" "), F.lit(1)))
    path = F.when(split, F.split_part(request, F.lit(" "), F.lit(2)))
    protocol = F.when(split, F.substring(request, F.length(method) + F.length(path) + 3, F.length(request)))
    return F.when(
        F.col("_nginx").isNotNull(),
        record(
            ctx.time(time), ip, "nginx", method, path, status.try_cast("int"), agent, strip(line),
            {
                "referer": referer,
                "bytes": size,
                "user": user,
                "protocol": F.coalesce(protocol, F.lit("")),
            },
        ),
    )


# --- firewall, JSON object ------------------------------------------------------


def _waf_prepare(line: Column) -> dict[str, Column]:
    return {"_waf": _json_object(line, WAF_KEYS)}


def _waf_entry(line: Column, ctx: ParseContext) -> Column:
    field = F.col("_waf").getField
    blank = F.lit("")
    return F.when(
        _is_object("_waf"),
        record(
            ctx.time(first_filled(_keys("_waf", WAF_TIME_KEYS))),
            first_filled(_keys("_waf", IP_KEYS)),
            "waf",
            field("method"),
            first_filled(_keys("_waf", PATH_KEYS)),
            field("status").try_cast("int"),
            first_filled(_keys("_waf", AGENT_KEYS)),
            line,
            {
                "rule_id": F.coalesce(field("rule_id"), blank),
                "rule_name": F.coalesce(field("rule_name"), blank),
                "action": F.coalesce(field("action"), F.lit("block")),
                "attack_type": F.coalesce(field("attack_type"), blank),
            },
        ),
    )


# --- free firewall: JSON array, JSON object, any line with an address ------------


def _quiet(line: Column) -> Column:
    """Blank and comment lines."""
    text = strip(line)
    return (text == "") | text.startswith("#")


def _free_array_prepare(line: Column) -> dict[str, Column]:
    return {"_list": _json_array(line)}


def _free_array_entry(line: Column, ctx: ParseContext) -> Column:
    items = F.col("_list")

    def item(i: int, missing: str, empty: Column | None = None) -> Column:
        value = F.get(items, F.lit(i))
        return F.when(F.size(items) > i, F.coalesce(value, empty) if empty is not None else value).otherwise(
            F.lit(missing)
        )

    none = F.lit("None")  # how a null item reads as text
    raw_request = item(7, "")
    return F.when(
        F.size(items) >= 4,
        record(
            ctx.time(items[0]), items[1], "free_waf", items[2], items[3], F.lit(403), F.lit(""),
            strip(line),
            {
                "rule_type": item(5, "", none),
                "rule_detail": item(6, "", none),
                "raw_request": F.substring(item(7, "", none), 1, RAW_REQUEST_LIMIT),
                "action": F.lit("block"),
                "domain": F.coalesce(F.regexp_extract(raw_request, HOST_HEADER, 1), F.lit("")),
            },
        ),
    )


def _free_object_prepare(line: Column) -> dict[str, Column]:
    return {"_free": _json_object(line, FREE_WAF_KEYS)}


def _free_object_entry(line: Column, ctx: ParseContext) -> Column:
    return F.when(
        _is_object("_free"),
        record(
            ctx.time(first_filled(_keys("_free", FREE_WAF_TIME_KEYS))),
            first_filled(_keys("_free", IP_KEYS)),
            "free_waf",
            F.coalesce(F.col("_free").getField("method"), F.lit("GET")),
            first_filled(_keys("_free", PATH_KEYS)),
            F.lit(403),
            first_filled(_keys("_free", AGENT_KEYS)),
            strip(line),
            {
                "rule_type": first_filled(_keys("_free", ("rule_type", "type"))),
                "action": F.lit("block"),
                "domain": first_filled(_keys("_free", ("domain", "host"))),
            },
        ),
    )


def _fallback_prepare(line: Column) -> dict[str, Column]:
    return {"_quad": F.regexp_extract(line, DOTTED_QUAD, 1)}


def _fallback_entry(line: Column, ctx: ParseContext) -> Column:
    return F.when(
        ~_quiet(line) & (F.col("_quad") != ""),
        record(
            ctx.now, F.col("_quad"), "free_waf", F.lit(""), F.lit(""), F.lit(403), F.lit(""),
            strip(line), {"action": F.lit("block")},
        ),
    )


# --- ssh ------------------------------------------------------------------------


def _ssh_prepare(line: Column) -> dict[str, Column]:
    return {"_ssh": regex_groups(strip(line), SSH_LINE, 4)}


def _ssh_entry(line: Column, ctx: ParseContext) -> Column:
    time, host, action, ip = (F.col("_ssh")[i] for i in range(4))
    failed = action.startswith("Failed") | action.startswith("Invalid")
    return F.when(
        F.col("_ssh").isNotNull(),
        record(
            ctx.time(time), ip, "ssh", F.lit("SSH"), F.lit("/ssh"),
            F.when(failed, 401).otherwise(200), F.lit(""), strip(line),
            {"action": action, "failed": failed, "host": host},
        ),
    )


NGINX = LineParser("nginx", _nginx_prepare, _nginx_entry)
WAF = LineParser("waf", _waf_prepare, _waf_entry)
FREE_WAF_ARRAY = LineParser("free_waf_array", _free_array_prepare, _free_array_entry)
FREE_WAF_OBJECT = LineParser("free_waf_object", _free_object_prepare, _free_object_entry)
FREE_WAF_FALLBACK = LineParser("free_waf_fallback", _fallback_prepare, _fallback_entry)
SSH = LineParser("ssh", _ssh_prepare, _ssh_entry)

# The formats tried for each source, in order.  "auto" takes lines of any source;
# SSH comes before the fallback, which would take every SSH line.
FORMATS: dict[str, tuple[LineParser, ...]] = {
    "nginx": (NGINX,),
    "waf": (WAF,),
    "free_waf": (FREE_WAF_ARRAY, FREE_WAF_OBJECT, FREE_WAF_FALLBACK),
    "ssh": (SSH,),
    "auto": (NGINX, WAF, FREE_WAF_ARRAY, SSH, FREE_WAF_FALLBACK),
}


def register_source(name: str, *parsers: LineParser) -> None:
    """Add a source of your own: its formats are tried in the given order."""
    FORMATS[name] = parsers


def parse_lines(
    lines: DataFrame, source: str, ctx: ParseContext | None = None, value: str = "value"
) -> DataFrame:
    """Records of the lines that parse; other columns of ``lines`` are kept."""
    ctx = ctx or ParseContext.current()
    parsers = FORMATS[source]
    kept = [c for c in lines.columns if c != value]
    prepared: dict[str, Column] = {}
    for parser in parsers:
        prepared |= parser.prepare(F.col(value))
    entries = [parser.entry(F.col(value), ctx) for parser in parsers]
    staged = once(once(lines, prepared), {"_entry": F.coalesce(*entries)})
    return staged.where(F.col("_entry").isNotNull()).select(
        *kept, *[F.col("_entry").getField(f).alias(f) for f in ENTRY_FIELDS]
    )
