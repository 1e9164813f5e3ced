"""IP addresses as column expressions.

Spark has no address type and an IPv6 address does not fit a number, so every
address becomes a sortable *key*: ``'4'`` and 8 hex digits, or ``'6'`` and 32 hex
digits.  Keys compare as strings in address order and the first character keeps
the two families apart.  No function here needs Python workers.

The expressions are written as SQL text: one call to the JVM builds each of them.
Arguments are column names or SQL expressions; an expression is repeated inside,
so give a column (``palisade.session.once`` makes one) where it is costly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import once

# Address syntax.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
HEXTETS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"
# Eight groups, or "::" with at most seven groups around it.
IPV6 = (
    r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}"
    rf"|(?!:*+(?:[0-9A-Fa-f]++:*+){{8}})(?:{HEXTETS})?::(?:{HEXTETS})?)$"
)
V4_IN_TEXT = r"(?U)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
V6_IN_TEXT = r"([0-9a-fA-F:]+:+[0-9a-fA-F:]+)"

# The IANA special-purpose registries, as private ranges and the
# globally reachable exceptions inside them.
PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
    "2002::/16", "fc00::/7", "fe80::/10",
)
PRIVATE_EXCEPTIONS = (
    "192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32",
    "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)


# SQL text of the blank characters, for btrim.
BLANKS = "' \\t\\n\\r\\u000b\\u000c'"


def strip(c: Column) -> Column:
    return F.btrim(c, F.expr(BLANKS))


def strip_sql(x: str) -> str:
    return f"btrim({x}, {BLANKS})"


def v4_number_sql(x: str) -> str:
    octets = [f"try_cast(split_part({x}, '.', {i}) as bigint)" for i in (1, 2, 3, 4)]
    return "({} * 16777216 + {} * 65536 + {} * 256 + {})".format(*octets)


def _hextets_sql(x: str) -> str:
    """Key of an address written in hextets only, NULL when it is not one.

    Every group is widened to four digits (``db8:1`` -> ``0DB80001``); the groups
    before ``::`` are filled up with zeros to where the groups after it begin.
    """

    def padded(part: str) -> str:
        wide = f"regexp_replace(upper({part}), '([0-9A-F]+)', '000$1')"
        return f"regexp_replace({wide}, '0*([0-9A-F]{{4}})(?::|$)', '$1')"

    left = padded(f"regexp_replace({x}, '::.*$', '')")
    right = padded(f"regexp_replace({x}, '^.*?(?:::|$)', '')")
    front = f"substring(rpad({left}, 32, '0'), 1, 32 - length({right}))"
    return f"case when {x} rlike r'{IPV6}' then concat('6', {front}, {right}) end"


def _v6_key_sql(x: str) -> str:
    address = f"regexp_replace({x}, '^([^%]+)%[^%]+$', '$1')"  # zone id
    tail = f"substring_index({address}, ':', -1)"
    zeroed = f"regexp_replace({address}, '[0-9.]+$', '0:0')"
    head = _hextets_sql(zeroed)
    digits = f"lpad(hex({v4_number_sql(tail)}), 8, '0')"
    dotted = f"case when {tail} rlike r'{IPV4}' then concat(substring({head}, 1, 25), {digits}) end"
    return f"case when contains({x}, '.') then {dotted} else {_hextets_sql(address)} end"


def _apart_sql(x: str, body: Callable[[str], str]) -> str:
    """A rare and long branch, kept out of the generated method.

    A generated method above 8,000 bytes of bytecode is never compiled by the JVM,
    and then every row pays.  The body of a lambda is evaluated outside of it, and
    its argument is evaluated once.
    """
    return f"transform(array({x}), a -> {body('a')})[0]"


def ip_key_sql(x: str) -> str:
    v4 = f"concat('4', lpad(hex({v4_number_sql(x)}), 8, '0'))"
    v6 = _apart_sql(x, _v6_key_sql)
    return f"case when {x} rlike r'{IPV4}' then {v4} when contains({x}, ':') then {v6} end"


def ip_key(x: str) -> Column:
    """Sortable key of a textual address, NULL when it is not a valid address."""
    return F.expr(ip_key_sql(x))


def is_valid_ip(x: str) -> Column:
    return F.expr(f"({ip_key_sql(x)}) is not null")


def clean_ip_sql(x: str) -> str:
    def cleaned(c: str) -> str:
        no_port = f"regexp_replace({strip_sql(c)}, '^([^:]*):[^:]*$', '$1')"
        no_brackets = f"regexp_replace({no_port}, r'(?s)^\\[([^\\]]*)\\].*$', '$1')"
        return strip_sql(f"split_part({no_brackets}, ',', 1)")

    # nearly every row is plain
    return f"case when {x} rlike r'{IPV4}' then {x} else {_apart_sql(x, cleaned)} end"


def clean_ip(x: str) -> Column:
    """Blanks, a port, brackets and a forwarded-for list removed; not yet validated."""
    return F.expr(clean_ip_sql(x))


def with_clean_ip(df: DataFrame, ip: str = "ip", key: str = "_key") -> DataFrame:
    """Normalise the ``ip`` column and add its key; both NULL without a valid address."""
    keyed = once(once(df, {ip: clean_ip(ip)}), {key: ip_key(ip)})
    return keyed.withColumn(ip, F.when(F.col(key).isNotNull(), F.col(ip)))


def with_extracted_ip(df: DataFrame, text: str, ip: str = "ip") -> DataFrame:
    """Add the first IPv4 address of a free text, else its first IPv6 address, else NULL."""
    found = once(
        df,
        {
            "_v4": F.expr(f"regexp_extract({text}, r'{V4_IN_TEXT}', 1)"),
            "_v6": F.expr(f"regexp_extract({text}, r'{V6_IN_TEXT}', 1)"),
        },
    )
    first = F.expr(f"case when _v4 rlike r'{IPV4}' then _v4 when ({ip_key_sql('_v6')}) is not null then _v6 end")
    return found.withColumn(ip, first).drop("_v4", "_v6")


def with_bounds(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Add ``kind``, ``lo`` and ``hi`` to address, network and start-end entries.

    The bounds are keys, NULL when the entry is invalid.  Host bits of a network
    may be set; its suffix is a prefix length, a netmask or a host mask.  A range
    whose start is above its end, or whose ends are of two families, is invalid.
    """
    texts = once(
        entries,
        {
            "kind": F.expr(
                f"case when contains({entry}, '/') then 'cidr' when contains({entry}, '-') then 'range' else 'ip' end"
            ),
            "_a": F.expr(
                f"""case when contains({entry}, '/') then split_part({entry}, '/', 1)
                when contains({entry}, '-') then {strip_sql(f"split_part({entry}, '-', 1)")} else {entry} end"""
            ),
            "_z": F.expr(
                f"""case when contains({entry}, '/') then substring({entry}, instr({entry}, '/') + 1)
                when contains({entry}, '-') then {strip_sql(f"substring({entry}, instr({entry}, '-') + 1)")}
                else {entry} end"""
            ),
        },
    )
    keyed = once(texts, {"_ka": ip_key("_a"), "_kz": ip_key("_z")})
    mask = "try_cast(conv(substring(_kz, 2, 8), 16, 10) as bigint)"
    inverse = f"(4294967295 ^ {mask})"
    sized = once(
        keyed,
        {
            "_bits": F.expr(
                f"""case when _z rlike '^[0-9]{{1,9}}$' then try_cast(_z as int)
                when _ka like '4%' and _kz like '4%' then 32 - case
                    when {inverse} & ({inverse} + 1) = 0 then bit_count({inverse})
                    when {mask} & ({mask} + 1) = 0 then bit_count({mask}) end end"""
            ),
            "_width": F.expr("case when _ka like '4%' then 8 else 32 end"),
        },
    )
    cut = once(  # the hex digit a prefix length cuts, and how many of its values stay open
        sized,
        {
            "_whole": F.expr("cast(_bits div 4 as int)"),
            "_free": F.expr("(cast(16 as bigint) >> (_bits % 4)) - 1"),
            "_digit": F.expr("try_cast(conv(substring(_ka, cast(_bits div 4 as int) + 2, 1), 16, 10) as bigint)"),
        },
    )
    inside = "kind = 'cidr' and _bits <= _width * 4"
    plain = "kind <> 'cidr' and _ka <= _kz and left(_ka, 1) = left(_kz, 1)"

    def bound(value: str, fill: str, key: str) -> Column:
        part = f"case when _bits % 4 > 0 then hex({value}) else '' end"
        network = f"rpad(concat(substring(_ka, 1, _whole + 1), {part}), _width + 1, '{fill}')"
        return F.expr(f"case when {inside} then {network} when {plain} then {key} end")

    low = "(_digit - (_digit & _free))"
    return once(
        cut, {"lo": bound(low, "0", "_ka"), "hi": bound(f"{low} + _free", "F", "_kz")}
    ).drop("_a", "_z", "_ka", "_kz", "_bits", "_width", "_whole", "_free", "_digit")


def _key_prefix(network: str) -> str:
    """Pattern of the keys inside a network: whole hex digits, then the cut digit as a class."""
    import ipaddress

    net = ipaddress.ip_network(network)
    width = 8 if net.version == 4 else 32
    lo, hi = f"{int(net.network_address):0{width}X}", f"{int(net.broadcast_address):0{width}X}"
    whole, cut = divmod(net.prefixlen, 4)
    return f"{net.version}{lo[:whole]}" + (f"[{lo[whole]}-{hi[whole]}]" if cut else "")


def is_private_key(key: Column) -> Column:
    """Private test on a key; an IPv4-mapped IPv6 address is judged as IPv4."""
    judged = F.regexp_replace(key, "^60{20}FFFF", "4")
    inside = "|".join(_key_prefix(n) for n in PRIVATE)
    outside = "|".join(_key_prefix(n) for n in PRIVATE_EXCEPTIONS)
    return F.coalesce(judged.rlike(f"^(?!{outside})(?:{inside})"), F.lit(False))


def with_private(df: DataFrame, ip: str = "ip", name: str = "is_private") -> DataFrame:
    """Add whether ``ip`` is a private address; false when it is not valid."""
    return once(df, {"_key": ip_key(ip)}).withColumn(name, is_private_key(F.col("_key"))).drop("_key")
