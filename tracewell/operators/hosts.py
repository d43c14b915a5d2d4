"""Who runs what, from where: owners of processes by their ancestors, names of addresses, panes by their server."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .settle import settled


def along_chain(rows: DataFrame, node: str, parent: str, least: list[str], nearest: list[str]) -> DataFrame:
    """(node, least and nearest columns): over a node and all above it, the least of each, and the first that is not null.

    Each round joins what is known of a node up to some ancestor with what is known from there, so chains of depth d take about log2(d)
    rounds. Of a cycle each node sees all.
    """
    at = settled(rows.select(F.col(node).alias("n"), F.col(parent).alias("up"), *least, *nearest))
    for _ in range(at.count().bit_length() + 1):  # a cycle has been gone round by then
        above = at.select(F.col("n").alias("__n"), F.col("up").alias("__up"), *[F.col(c).alias(f"__{c}") for c in (*least, *nearest)])
        both = at.join(above, F.col("up") == F.col("__n"), "left")
        if both.filter("__n IS NOT NULL AND NOT __up <=> n").isEmpty():
            break
        at = settled(
            both.select("n", F.col("__up").alias("up"), *[F.least(c, f"__{c}").alias(c) for c in least], *[F.coalesce(c, f"__{c}").alias(c) for c in nearest])
        )
    return at.drop("up").withColumnRenamed("n", node)


def owners(processes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(pid, session, via) of processes (pid, ppid, args): the first of sessions (pid, ip) that the process or one above it is, and else what above it tells.

    In order: a session, by least pid; a terminal multiplexer above; a user's service manager; the nearest editor's agent or shell; init as its
    parent; what its parent runs, 30 code points of it, or ? if that is not known.
    """
    args = F.col("args")
    mux = F.when(F.lower(args).startswith("tmux") | F.lower(args).startswith("screen"), True)
    user = F.when(args.contains("systemd --user"), True)
    agent = args.contains(" agent host ") | args.endswith(" agent host") | args.contains("command-shell")
    under = F.when(text.editor(args).isNotNull() & agent, F.concat(F.lit("under "), text.editor(args), F.lit(" pid "), F.col("pid").cast("string")))
    marked = processes.join(sessions.select(F.col("pid").alias("session"), "ip"), F.col("pid") == F.col("session"), "left")
    marked = marked.select("pid", "ppid", "args", F.when(F.col("session").isNotNull(), F.struct("session", "ip")).alias("of"), mux.alias("mux"), user.alias("user"), under.alias("under"))
    seen = settled(along_chain(marked, "pid", "ppid", ["of"], ["mux", "user", "under"]))
    above = seen.select(F.col("pid").alias("__p"), "mux", "user", "under").join(processes.select(F.col("pid").alias("__p"), F.col("args").alias("parent")), "__p")
    out = processes.select("pid", "ppid").join(seen.select("pid", "of"), "pid").join(above, F.col("ppid") == F.col("__p"), "left")
    via = (
        F.when(F.col("of").isNotNull(), F.concat(F.lit("ssh from "), F.coalesce("of.ip", F.lit("?"))))
        .when(F.col("mux"), "tmux/screen").when(F.col("user"), "systemd user service").when(F.col("under").isNotNull(), F.col("under"))
        .when(F.col("ppid") == 1, "detached (parent is init)").otherwise(F.coalesce(F.left("parent", F.lit(30)), F.lit("?")))
    )
    return out.select("pid", F.col("of.session").alias("session"), via.alias("via"))


def named_addresses(addresses: DataFrame, here: DataFrame, peers: DataFrame, endpoints: DataFrame, notes: DataFrame) -> DataFrame:
    """(ip, name, source) of addresses (ip): the first that holds of loopback, this machine, a peer, a peer's endpoint, the overlay network, an endpoint seen before, a note, a private address, a public one.

    here: (ip); peers: (ip, peer, endpoint), the endpoint's address null where there is none; endpoints: (ip, peer) seen before, which count while the peer is still
    known; notes: (ip, note). Of several entries for an address the least counts. Brackets, and a prefix for IPv4 in IPv6, do not.
    """
    least = lambda df, value: df.filter("ip IS NOT NULL").groupBy("ip").agg(F.min(value).alias(value))
    a = addresses.select("ip", text.unmapped(F.translate("ip", "[]", "")).alias("bare")).distinct()
    by = lambda df: F.col("bare") == df["__ip"]
    sides = {
        "local": here.select("ip").distinct().withColumn("local", F.lit(True)), "peer": least(peers.select("ip", "peer"), "peer"),
        "endpoint": least(peers.select(F.col("endpoint").alias("ip"), F.col("peer").alias("endpoint")), "endpoint"),
        "before": least(endpoints.join(peers.select("peer").distinct(), "peer").select("ip", F.col("peer").alias("before")), "before"), "note": least(notes, "note"),
    }
    for name, df in sides.items():
        side = df.select(F.col("ip").alias("__ip"), name)
        a = a.join(side, by(side), "left").drop("__ip")
    kind = text.address_class(F.col("bare"))
    rules = [
        (kind == "loopback", F.lit("the machine itself"), "loopback"), (F.col("local"), F.lit("this machine"), "local"), (F.col("peer").isNotNull(), F.col("peer"), "peer"),
        (F.col("endpoint").isNotNull(), F.col("endpoint"), "endpoint"), (kind == "overlay", F.coalesce("note", F.lit("an overlay address of no known peer")), "overlay"), (F.col("before").isNotNull(), F.col("before"), "seen before"),
        (F.col("note").isNotNull(), F.col("note"), "note"), (kind == "private", F.lit("unknown"), "private"),
    ]
    name, source = F.lit("unknown (public address)"), F.lit("public")
    for holds, value, of in reversed(rules):
        name, source = F.when(holds, value).otherwise(name), F.when(holds, of).otherwise(source)
    return a.select("ip", name.alias("name"), source.alias("source"))


def panes(logins: DataFrame) -> DataFrame:
    """(server, user, panes, time) of logins (user, time, origin) that a multiplexer's panes are, one row for each server: "tmux(PID)..."; the least time, and the user of it."""
    server = F.when(F.col("origin").startswith("tmux("), F.substring_index(F.substring("origin", 6, 1 << 30), ")", 1).try_cast("long"))
    own = logins.withColumn("server", server).filter("server IS NOT NULL")
    return own.groupBy("server").agg(F.min_by("user", F.struct("time", "user")).alias("user"), F.count("*").alias("panes"), F.min("time").alias("time"))
