"""Parsing of log lines, host listings and transcripts as Column expressions (regular expressions run in the JVM)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(line: Column, pattern: str, names: str) -> Column:
    """A struct of the pattern's groups, null where the line does not match; a group that took no part is null."""
    groups = [F.nullif(F.regexp_extract(line, pattern, i), F.lit("")).alias(n) for i, n in enumerate(names.split(), 1)]
    return F.when(line.rlike(pattern), F.struct(*groups))


def unmapped(ip: Column) -> Column:
    """An IPv4 address without the prefix that IPv6 sockets write before it."""
    return F.regexp_replace(ip, "^::ffff:", "")


def words(line: Column, most: int = -1) -> Column:
    """The line's words; the last of most holds the rest of the line."""
    return F.split(F.regexp_replace(line, r"^\s+", ""), r"\s+", most)


def process(line: Column, now: Column) -> Column:
    """pid, ppid, started, tty, user, args of a line of process status (pid, ppid, seconds, tty, user, command); null where the numbers are none."""
    w = words(line, 6)
    pid, ppid, elapsed = (F.get(w, i).try_cast("long") for i in range(3))
    tty, user, args = F.get(w, 3), F.get(w, 4), F.get(w, 5)
    whole = pid.isNotNull() & ppid.isNotNull() & elapsed.isNotNull() & args.isNotNull()
    return F.when(whole, F.struct(pid.alias("pid"), ppid.alias("ppid"), (now - elapsed).alias("started"), F.nullif(tty, F.lit("?")).alias("tty"), user.alias("user"), args.alias("args")))


def accepted(line: Column) -> Column:
    """time, pid, method, user, ip, port, key_type, fingerprint of a line on an accepted login.

    Its words: seconds, host, the daemon with its pid in brackets, "Accepted", a method, "for", a user, "from", an address, "port", a port; then
    perhaps the protocol; and after a colon the kind of key and its fingerprint.
    """
    w = F.split(line, " ")
    at = lambda i: F.get(w, i)
    daemon = F.substring_index(at(2), "[", 1)
    pid = F.substring_index(F.substring_index(at(2), "[", -1), "]", 1).try_cast("long")
    time, port = F.substring_index(at(0), ".", 1).try_cast("long"), F.rtrim(F.translate(at(10), ":", " ")).try_cast("long")
    said = [(3, "Accepted"), (5, "for"), (7, "from"), (9, "port")]
    good = daemon.isin("sshd", "sshd-session") & time.isNotNull() & pid.isNotNull() & port.isNotNull()
    for i, word in said:
        good = good & (at(i) == word)
    key = F.when(at(10).endswith(":"), 11).when(at(11) == "ssh2:", 12)
    both = F.get(w, key + 1).isNotNull()
    named = {"time": time, "pid": pid, "method": at(4), "user": at(6), "ip": unmapped(at(8)), "port": port, "key_type": F.when(both, F.get(w, key)), "fingerprint": F.when(both, F.get(w, key + 1))}
    return F.when(good, F.struct(*[c.alias(n) for n, c in named.items()]))


def logged_in(line: Column, offset_s: Column, year: int) -> Column:
    """user, tty, time, origin of a line of the login listing; the date is of either shape, in local time offset_s ahead."""
    w = words(line)
    pick = lambda i, n: F.array_join(F.slice(w, i, n), " ")
    iso = F.when(F.size(w) >= 4, F.try_to_timestamp(pick(3, 2), F.lit("yyyy-MM-dd HH:mm")))
    named = F.when(F.size(w) >= 5, F.try_to_timestamp(F.concat(F.lit(f"{year} "), pick(3, 3)), F.lit("yyyy MMM d HH:mm")))
    origin = F.when(F.rtrim(line).endswith(")") & line.contains("("), F.substring_index(F.substring_index(F.rtrim(line), "(", -1), ")", 1))
    at = F.coalesce(iso, named)
    return F.when(at.isNotNull(), F.struct(F.get(w, 0).alias("user"), F.get(w, 1).alias("tty"), (F.unix_timestamp(at) - offset_s).alias("time"), origin.alias("origin")))


# fixed values: folders of editors' remote servers, and the editors' names
EDITORS = {"vscode": "VS Code", "vscode-insiders": "VS Code", "vscode-server-insiders": "VS Code", "cursor": "Cursor", "windsurf": "Windsurf"}
COPIERS = ("scp", "rsync")


def editor(args: Column) -> Column:
    """The editor whose remote server a command belongs to; null for any other."""
    out = F.lit(None).cast("string")
    for folder, name in EDITORS.items():
        out = F.when(args.contains(f"/.{folder}-server/"), name).otherwise(out)
    return out


def copier(args: Column) -> Column:
    """The copying command that args call; null for any other."""
    first = F.get(F.split(args, r"\s"), 0)
    return F.when(first.isin(*COPIERS) & (F.length(args) > F.length(first)), first)


def by_header(line: Column, header: Column, name: str) -> Column:
    """The field of a listing's line that stands where name stands in its header; null if it has none."""
    split = lambda c: F.split(F.trim(c), r"\s+")
    at = F.array_position(split(header), name)
    return F.when(at > 0, F.get(split(line), (at - 1).cast("int")))


# fixed values: the levels of the two kinds of console lines
LEVELS = {"TRACE": "tra", "DEBUG": "deb", "INFO": "inf", "WARN": "war", "ERROR": "err"}
INTERESTING = ("war", "err", "cri", "exc")


def console(line: Column) -> Column:
    """level, logger, message of a console line of either kind; null for any other line.

    One kind begins with a time of day and has level and logger in brackets; the other with a full time and a level, and names its logger
    as a path with :: before a colon.
    """
    stamp = F.substring_index(line, " ", 1)
    shape, rest = F.translate(stamp, "0123456789", ""), F.ltrim(F.substr(line, F.length(stamp) + 1))
    boxes = F.split(rest, "]", 3)
    level, logger, text = F.substr(F.get(boxes, 0), F.lit(2)), F.substr(F.get(boxes, 1), F.lit(2)), F.get(boxes, 2)
    own = (shape == "::.") & rest.startswith("[") & F.get(boxes, 1).startswith("[") & text.isNotNull() & (level != "") & ~level.contains(" ")
    text = F.when(text.startswith(" "), F.substr(text, F.lit(2))).otherwise(text)
    named = F.substring_index(rest, " ", 1)
    path = F.get(F.filter(F.split(rest, " "), lambda x: x.endswith(":") & x.contains("::") & ~x.endswith("::")), 0)
    native = shape.isin("--T::Z", "--T::.Z") & named.isin(*LEVELS) & path.isNotNull()
    said = F.substr(rest, F.position(path, rest) + F.length(path) + 1)
    short = F.coalesce(*[F.when(named == k, v) for k, v in LEVELS.items()])
    return F.when(own, F.struct(F.lower(level).alias("level"), F.trim(logger).alias("logger"), text.alias("message"))).when(
        native, F.struct(short.alias("level"), F.left(path, F.length(path) - 1).alias("logger"), said.alias("message"))
    )


def repeat_key(message: Column) -> Column:
    """What repeated warnings have in common: the text before the first "=", 60 code points of it."""
    return F.substring(F.substring_index(message, "=", 1), 1, 60)


# fixed values: kinds of link events, the first that a line meets
LINK_EVENTS = (
    ("tx_frag_drop", "skb total frag"), ("scan", "scan_ch_ready_cb"), ("disconnect", "deauth|disconnect"), ("assoc", "assoc"),
    ("roam", "roam"), ("beacon", "beacon"), ("nm_state", "state is now"),
)


def link_event(line: Column) -> Column:
    out = F.lit("other")
    for kind, pattern in reversed(LINK_EVENTS):
        out = F.when(line.rlike(f"(?i){pattern}"), kind).otherwise(out)
    return out


def channel(name: Column, namespace: str = "fleet") -> Column:
    """A channel without leading slash, namespace and type: #type, or a last part with a dot."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^/", ""), f"^{namespace}/", ""), "#.*$", "")
    return F.regexp_replace(bare, r"/[^/]*\.[^/]*$", "")


def tool_message(content: Column) -> Column:
    """tool and text of "[tool:NAME] text"; null for any other content."""
    return fields(content, r"(?s)^\[tool:([^\]]*)\]\s*(.*)$", "tool text")


NUMBER = r"-?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def numbers(text: Column) -> Column:
    """Texts of the quantities in a text: numbers that are no part of a word or a version, nor what follows a date's year.

    Matches are taken from left to right; one counts unless a letter, digit, dot, _ or # stands before it or a dot and a digit after
    it. What stands around a match comes from the gaps between matches, so no offset is needed.
    """
    gaps, found = F.split(text, NUMBER, -1), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))

    def kept(i: Column) -> Column:
        gap, nxt = F.get(gaps, i), F.get(gaps, i + 1)
        # with no gap between two matches, the neighbour is the other match's own end
        before = F.when((gap == "") & (i > 0), F.get(found, i - 1)).otherwise(gap)
        after = F.when(nxt == "", F.coalesce(F.get(found, i + 1), F.lit(""))).when(nxt == ".", F.concat(nxt, F.coalesce(F.get(found, i + 1), F.lit("")))).otherwise(nxt)
        return ~before.rlike(r"[A-Za-z_#\d.]$") & ~after.rlike(r"^\.\d")

    places = F.filter(F.sequence(F.lit(0), F.size(found)), lambda i: (i < F.size(found)))
    return F.transform(F.filter(places, kept), lambda i: F.get(found, i))


def address_class(ip: Column) -> Column:
    """loopback, overlay (100.64.0.0/10 and its IPv6 range), private (link-local too) or public of an address; name of anything else. Brackets round it do not count."""
    bare = F.lower(F.translate(ip, "[]", ""))
    parts = F.split(bare, "[.]")
    number = lambda i: F.get(parts, i).try_cast("int")
    four = (F.size(parts) == 4) & (F.translate(bare, "0123456789", "") == "...") & number(0).between(0, 255) & number(1).between(0, 255) & number(2).isNotNull() & number(3).isNotNull()
    six = (F.size(F.split(bare, ":")) > 2) & (F.translate(bare, "0123456789abcdef.:", "") == "")
    a, b = number(0), number(1)
    own = (a == 10) | (a == 192) & (b == 168) | (a == 172) & b.between(16, 31) | (a == 169) & (b == 254)
    return (
        F.when(four & (a == 127) | (bare == "::1"), "loopback")
        .when(four & (a == 100) & b.between(64, 127) | six & bare.startswith("fd7a:115c:a1e0:"), "overlay")
        .when(four & own, "private")
        .when(four | six, "public")
        .otherwise("name")
    )


def hex_address(text: Column) -> Column:
    """"0100007F:1F90" of a socket table as "127.0.0.1:8080": four bytes, the last first, and the port."""
    byte = lambda i: F.conv(F.substring(text, i, 2), 16, 10)
    return F.concat(F.concat_ws(".", *[byte(i) for i in (7, 5, 3, 1)]), F.lit(":"), F.conv(F.substring_index(text, ":", -1), 16, 10))
