"""Parsers of log lines, listings and messages. Lines are spelt from table rows and parsed; the SQL tells the rows they were spelt from."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import hosts
from ..operators.profile import micros
from .registry import query, table

NOW = 1_700_000_000


@query(f"SELECT o_orderkey AS pid, o_custkey AS ppid, {NOW} - o_orderkey % 1000 AS started, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'pts/' || (o_orderkey % 5) END AS tty, 'user' || (o_custkey % 7) AS user, 'python3 -m run ' || o_orderstatus AS args FROM orders")
def process_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("format_string('%7d %d  %d %s user%d python3 -m run %s', o_orderkey, o_custkey, o_orderkey % 1000, IF(o_orderkey % 3 = 0, '?', concat('pts/', o_orderkey % 5)), o_custkey % 7, o_orderstatus)")
    return table(spark, sf_dir, "orders").select(text.process(line, F.lit(NOW)).alias("p")).filter("p IS NOT NULL").select("p.*")


@query(
    """SELECT 1700000000 + event_id AS time, event_id + 1 AS pid, CASE WHEN event_id % 2 = 0 THEN 'publickey' ELSE 'password' END AS method, 'u' || user_id AS user, '10.0.' || (user_id % 200) || '.7' AS ip, 1024 + event_id % 60000 AS port,
    CASE WHEN event_id % 2 = 0 THEN 'ED25519' END AS key_type, CASE WHEN event_id % 2 = 0 THEN 'SHA256:k' || (user_id % 9) END AS fingerprint FROM events WHERE event_type <> 'error'"""
)
def accepted_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(
        """CASE WHEN event_type = 'error' THEN format_string('%d.25 host sshd[%d]: Failed password for u%d', 1700000000 + event_id, event_id + 1, user_id)
        ELSE format_string('%d.25 host sshd%s[%d]: Accepted %s for u%d from %s10.0.%d.7 port %d ssh2%s', 1700000000 + event_id, IF(event_id % 5 = 0, '-session', ''), event_id + 1, IF(event_id % 2 = 0, 'publickey', 'password'), user_id,
        IF(event_id % 3 = 0, '::ffff:', ''), user_id % 200, 1024 + event_id % 60000, IF(event_id % 2 = 0, concat(': ED25519 SHA256:k', user_id % 9), '')) END"""
    )
    return table(spark, sf_dir, "events").select(text.accepted(line).alias("a")).filter("a IS NOT NULL").select("a.*")


@query("SELECT 'u' || user_id AS user, 'pts/' || (event_id % 9) AS tty, (epoch_us(date_trunc('minute', ts)) // 1000000) - 3600 AS time, CASE WHEN event_id % 3 = 0 THEN '10.1.1.' || (user_id % 250) END AS origin FROM events")
def login_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of two shapes; the day of one padded as the C locale does. Local time is an hour ahead."""
    line = F.expr("format_string('u%d pts/%d  %s%s', user_id, event_id % 9, IF(event_id % 2 = 0, date_format(ts, 'yyyy-MM-dd HH:mm'), date_format(ts, 'MMM d HH:mm')), IF(event_id % 3 = 0, concat(' (10.1.1.', user_id % 250, ')'), ''))")
    return table(spark, sf_dir, "events").select(text.logged_in(line, F.lit(3600), 2024).alias("w")).filter("w IS NOT NULL").select("w.*")


@query("SELECT s_suppkey AS pid, round(s_acctbal::DOUBLE / 100, 2) AS cpu, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey::DOUBLE END AS mem FROM supplier")
def top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by where the header has them; every other header has them elsewhere and no %MEM."""
    s = table(spark, sf_dir, "supplier")
    cpu = F.round(F.col("s_acctbal").cast("double") / 100, 2).cast("string")
    even = F.col("s_nationkey") % 2 == 0
    header = F.when(even, "  PID USER %CPU %MEM COMMAND").otherwise("  PID COMMAND USER   %CPU")
    line = F.when(even, F.concat_ws("  ", F.lit(""), F.col("s_suppkey"), F.lit("root"), cpu, F.col("s_nationkey"), F.lit("x"))).otherwise(F.concat_ws(" ", F.col("s_suppkey"), F.lit("x"), F.lit("root"), cpu))
    field = lambda n, kind: text.by_header(line, header, n).cast(kind)
    return s.select(field("PID", "long").alias("pid"), field("%CPU", "double").alias("cpu"), field("%MEM", "double").alias("mem"))


@query("SELECT 'SHA256:' || md5(c_custkey::VARCHAR) AS fingerprint, c_name || ' laptop' AS comment FROM customer WHERE c_custkey % 4 <> 3")
def key_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("IF(c_custkey % 4 = 3, '# a comment', format_string('256 SHA256:%s %s laptop (ED25519)', md5(cast(c_custkey AS STRING)), c_name))")
    return table(spark, sf_dir, "customer").select(text.fields(line, r"^\d+ (SHA256:\S+) (.*) \(\S+\)$", "fingerprint comment").alias("k")).filter("k IS NOT NULL").select("k.*")


@query("SELECT n_regionkey AS host, 'k' || n_nationkey AS peer, n_name AS name, '100.64.0.' || n_nationkey AS ip, n_nationkey % 2 = 0 AS online FROM nation")
def peer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers of a status document: a JSON object of one object for each."""
    peer = F.expr("format_string('\"k%d\":{\"HostName\":\"%s\",\"TailscaleIPs\":[\"100.64.0.%d\",\"fd7a:115c:a1e0::%d\"],\"Online\":%s}', n_nationkey, n_name, n_nationkey, n_nationkey, IF(n_nationkey % 2 = 0, 'true', 'false'))")
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit('{"Version":"1","Peer":{'), F.array_join(F.collect_list(peer), ","), F.lit("}}")).alias("json"))
    status = F.from_json("json", "Peer map<string, struct<HostName:string,TailscaleIPs:array<string>,Online:boolean>>")
    out = docs.select(F.col("n_regionkey").alias("host"), F.explode(status["Peer"]).alias("peer", "p"))
    return out.select("host", "peer", F.col("p.HostName").alias("name"), F.col("p.TailscaleIPs")[0].alias("ip"), F.col("p.Online").alias("online"))


@query("SELECT c_custkey, (c_custkey % 256) || '.' || (c_nationkey) || '.0.' || (c_custkey // 256 % 256) || ':' || (1024 + c_custkey % 5000) AS address FROM customer")
def socket_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.expr("format_string('%02X%02X%02X%02X:%04X', c_custkey div 256 % 256, 0, c_nationkey, c_custkey % 256, 1024 + c_custkey % 5000)")
    return table(spark, sf_dir, "customer").select("c_custkey", text.hex_address(entry).alias("address"))


@query("SELECT n_regionkey AS host, section, line FROM (SELECT n_regionkey, 'PS' AS section, 'p ' || n_name AS line FROM nation UNION ALL SELECT n_regionkey, 'WHO', 'w ' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0)")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under the last marker before them; markers of one value, and blank lines, hold none."""
    n = table(spark, sf_dir, "nation")
    lines = n.groupBy("n_regionkey").agg(
        F.concat(
            F.lit("@@NOW 1700000000\n@@PS\n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("p "), "n_name"))), "\n"), F.lit("\n\n@@LOAD 0.5\nignored\n@@WHO\n"),
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("w "), F.col("n_nationkey").cast("string"))))), "\n"),
        ).alias("text")
    )
    parts = lines.select("n_regionkey", F.explode(F.split("text", r"(?m)^@@")).alias("part"))
    named = parts.select("n_regionkey", F.regexp_extract("part", r"^(\w+)", 1).alias("section"), F.explode(F.slice(F.split("part", "\n"), 2, 1 << 30)).alias("line"))
    return named.filter(~F.col("section").isin("NOW", "SELF", "SELFCONN", "ID", "LOAD") & (F.trim("line") != "")).select(F.col("n_regionkey").alias("host"), "section", "line")


LEVEL = "['inf', 'war', 'err', 'deb'][1 + event_id % 4]"
LOGGED = f"(SELECT event_id, {LEVEL} AS level, CASE WHEN event_id % 3 = 0 THEN 'net::node' ELSE 'module ' || (user_id % 5) END AS logger, event_type || ' late by=' || value AS message FROM events)"


def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(
        """IF(event_id % 3 = 0,
        format_string('2026-10-13T02:03:49.050480Z  %s net-0 ThreadId(03) net::node: %s late by=%s', element_at(array('INFO', 'WARN', 'ERROR', 'DEBUG'), cast(1 + event_id % 4 AS INT)), event_type, value),
        format_string('12:00:01.123 [%s][module %d   ] %s late by=%s', element_at(array('inf', 'war', 'err', 'deb'), cast(1 + event_id % 4 AS INT)), user_id % 5, event_type, value))"""
    )
    return table(spark, sf_dir, "events").select("event_id", "event_type", text.console(line).alias("c")).filter("c IS NOT NULL").select("event_id", "event_type", "c.*")


@query(f"SELECT event_id, level, logger, message FROM {LOGGED} WHERE level IN ('war', 'err', 'cri', 'exc')")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of either kind with their level normalised; those of no interest go."""
    return console_lines(spark, sf_dir).filter(F.col("level").isin(*text.INTERESTING)).drop("event_type")


@query(f"SELECT logger, level, split_part(message, '=', 1)[:60] AS head, count(*) AS n FROM {LOGGED} WHERE level IN ('war', 'err') GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, logger, level, head LIMIT 5")
def warn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most repeated warnings, told by logger, level and the text before the first value."""
    g = log_lines(spark, sf_dir).groupBy("logger", "level", text.repeat_key(F.col("message")).alias("head")).agg(F.count("*").alias("n"))
    return g.filter("n > 1").orderBy(F.desc("n"), "logger", "level", "head").limit(5)


@query(f"SELECT event_id, message FROM {LOGGED} WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def noise_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines but those of a noisy pattern."""
    lines = console_lines(spark, sf_dir)
    return lines.filter(~F.col("message").rlike("^view late")).select("event_id", "message")


@query("SELECT 'noise: ' || event_type || ' late' AS note, min(event_id) AS first_id, count(*) AS hidden FROM events WHERE event_type = 'view' GROUP BY 1")
def noise_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note for each noisy pattern, at its first line."""
    noisy = console_lines(spark, sf_dir).filter(F.col("message").rlike("^view late"))
    return noisy.groupBy(F.lit("noise: view late").alias("note")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("hidden"))


EVENTS = "['tx_frag_drop', 'scan', 'disconnect', 'assoc', 'roam', 'beacon', 'nm_state', 'other', 'disconnect', 'scan']"


@query(f"SELECT event_id, {EVENTS}[1 + event_id % 10] AS kind FROM events")
def link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight kinds; the ninth and tenth lines meet two patterns, of which the first counts."""
    shapes = ["RTW: SKB total frag over", "RTW: scan_ch_ready_cb", "wlan0: deauthenticated", "RTW: associated", "wpa: roam to", "RTW: beacon lost", "NetworkManager: state is now CONNECTED", "kernel: hello", "wlan0: disassoc and Disconnect", "RTW: scan_ch_ready_cb assoc"]
    line = F.element_at(F.array(*[F.lit(x) for x in shapes]), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.link_event(line).alias("kind"))


@query("SELECT event_id, [event_type, 'a/' || event_type, 'robot/' || event_type, event_type][1 + event_id % 4] AS channel FROM events")
def channel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = [F.concat(F.lit("/"), "event_type"), F.concat(F.lit("/fleet/a/"), "event_type", F.lit("#sensor.Image")), F.concat(F.lit("fleet/robot/"), "event_type", F.lit("/module.Type")), F.col("event_type")]
    return table(spark, sf_dir, "events").select("event_id", text.channel(F.element_at(F.array(*shapes), (F.col("event_id") % 4 + 1).cast("int"))).alias("channel"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN role END AS tool, CASE WHEN turn % 2 = 1 THEN ltrim(text, E' \\t\\n\\r') END AS text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool and text of messages behind a tool prefix; null for those without."""
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND role IS NOT NULL")
    content = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("[tool:"), "role", F.lit("]  "), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", text.tool_message(content).alias("m")).select("conv_id", "turn", "m.tool", F.col("m.text").alias("text"))


@query("SELECT event_id, [NULL, event_type, event_type, event_type][1 + event_id % 4] AS name, CASE WHEN event_id % 4 IN (1, 2) THEN props END AS k, CASE event_id % 4 WHEN 3 THEN 'half {' END AS raw FROM events")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of two shapes: name and args, or both under function with the arguments as a text of JSON, which may be cut short."""
    escaped = F.regexp_replace("props", '"', '\\\\"')
    shapes = [
        F.lit('{"id":"1"}'),
        F.concat(F.lit('{"name":"'), "event_type", F.lit('","args":'), "props", F.lit("}")),
        F.concat(F.lit('{"function":{"name":"'), "event_type", F.lit('","arguments":"'), escaped, F.lit('"}}')),
        F.concat(F.lit('{"function":{"name":"'), "event_type", F.lit('","arguments":"half {"}}')),
    ]
    e = table(spark, sf_dir, "events").select("event_id", "props", F.element_at(F.array(*shapes), (F.col("event_id") % 4 + 1).cast("int")).alias("call"))
    field = lambda *paths: F.coalesce(*[F.get_json_object("call", p) for p in paths])
    e = e.withColumn("name", field("$.name", "$.function.name")).withColumn("args", field("$.args", "$.function.arguments"))
    parsed = F.get_json_object("args", "$.k")
    return e.select("event_id", "name", F.when(parsed.isNotNull(), F.format_string('{"k": %s}', parsed)).alias("k"), F.when(parsed.isNull(), F.col("args")).alias("raw"))


@query("SELECT conv_id, turn, [CASE WHEN role = 'assistant' THEN 'ai' ELSE role END, 'ai', 'human', 'unknown'][1 + turn % 4] AS role FROM conversations")
def message_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared type, else what the class name holds."""
    declared = F.when(F.col("turn") % 4 == 0, F.coalesce("role", F.lit("")))
    cls = F.element_at(F.array(F.lit("x"), F.lit("messages.AI.AIMessage"), F.lit("core.messages.HumanMessage"), F.lit("core.Thing")), (F.col("turn") % 4 + 1).cast("int"))
    out = F.lit("unknown")
    for kind in reversed(("ai", "human", "system", "tool", "chat", "function")):
        out = F.when(F.lower(cls).contains(f".{kind}message") | F.lower(cls).contains(f".{kind}."), kind).otherwise(out)
    role = F.when(declared == "assistant", "ai").when(declared != "", declared).otherwise(out)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"))


@query("SELECT event_id, [event_type, event_type || user_id, '', '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}'][1 + event_id % 4] AS text FROM events")
def message_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a message whose content is a string, a list of strings and blocks, nothing, or something else, which is told as JSON."""
    compact = F.regexp_replace("props", r"\s", "")
    shapes = [
        F.concat(F.lit('{"content":"'), "event_type", F.lit('"}')),
        F.concat(F.lit('{"content":["'), "event_type", F.lit('",{"type":"image"},{"text":"'), F.col("user_id").cast("string"), F.lit('"}]}')),
        F.lit('{"content":null}'),
        F.concat(F.lit('{"content":'), compact, F.lit("}")),
    ]
    content = F.get_json_object(F.element_at(F.array(*shapes), (F.col("event_id") % 4 + 1).cast("int")), "$.content")
    # an element is a string, or an object whose text counts
    blocks = F.from_json(content, "array<string>")
    part = lambda b: F.when(b.startswith("{"), F.coalesce(F.get_json_object(b, "$.text"), F.lit(""))).otherwise(b)
    out = F.when(content.isNull(), "").when(content.startswith("["), F.array_join(F.transform(blocks, part), "")).otherwise(content)
    return table(spark, sf_dir, "events").select("event_id", out.alias("text"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN k || '/100' WHEN 1 THEN k::VARCHAR ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ' ' || event_type ELSE '' END AS progress FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_id % 3 < 2")
def progress_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """progress/total and what is being done, of those parts there are."""
    e = table(spark, sf_dir, "events").filter("event_id % 3 < 2").withColumn("k", F.get_json_object("props", "$.k"))
    total = F.when(F.col("event_id") % 3 == 0, "100")
    return e.select("event_id", F.concat_ws(" ", F.concat_ws("/", "k", total), F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("progress"))


@query("SELECT event_id, ['12.5,-3,1e3', '2026,7', '', '.5,4'][1 + event_id % 4] AS found FROM events")
def number_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities but no parts of words or versions, and of a date the year alone."""
    shapes = ["at 12.5 m, down -3 to 1e3", "v1.2.3 of fleet6 on 2026-09-18: 7", "utf8 #ff0 10.0.0.1", "x=.5;(4)"]
    line = F.element_at(F.array(*[F.lit(x) for x in shapes]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(text.numbers(line), ",").alias("found"))


IPS = "[ '127.0.0.' || (c_nationkey + 1), '100.' || (64 + c_nationkey) || '.3.4', '192.168.' || c_nationkey || '.1', '172.' || (16 + c_nationkey % 16) || '.0.9', '8.8.' || c_nationkey || '.8', 'fd7a:115c:a1e0::' || c_nationkey, 'host' || c_nationkey, '100.' || (c_nationkey) || '.3.4']"


@query(f"SELECT c_custkey, {IPS}[1 + c_custkey % 8] AS ip, ['loopback', 'overlay', 'private', 'private', 'public', 'overlay', 'name', 'public'][1 + c_custkey % 8] AS class FROM customer")
def address_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select("c_custkey", address().alias("ip"))
    return d.withColumn("class", text.address_class(F.col("ip")))


def address():
    n = F.col("c_nationkey").cast("string")
    shift = lambda k: (F.col("c_nationkey") + k).cast("string")
    shapes = [F.concat(F.lit("127.0.0."), shift(1)), F.concat(F.lit("100."), shift(64), F.lit(".3.4")), F.concat(F.lit("192.168."), n, F.lit(".1")), F.concat(F.lit("172."), (F.col("c_nationkey") % 16 + 16).cast("string"), F.lit(".0.9")), F.concat(F.lit("8.8."), n, F.lit(".8")), F.concat(F.lit("fd7a:115c:a1e0::"), n), F.concat(F.lit("host"), n), F.concat(F.lit("100."), n, F.lit(".3.4"))]
    return F.element_at(F.array(*shapes), (F.col("c_custkey") % 8 + 1).cast("int"))


@query(f"SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'this machine' WHEN 6 THEN ip ELSE coalesce((SELECT min(n_name) FROM nation WHERE '192.168.' || n_nationkey || '.1' = ip AND n_nationkey % 2 = 0), CASE WHEN c_custkey % 8 IN (2, 3) THEN 'local network' WHEN c_custkey % 8 IN (1, 5) THEN 'overlay network' ELSE ip END) END AS name FROM (SELECT *, {IPS}[1 + c_custkey % 8] AS ip FROM customer)")
def address_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first that holds: this machine, a known host, the kind of network, the address as it is."""
    known = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("192.168."), F.col("n_nationkey").cast("string"), F.lit(".1")).alias("ip"), F.col("n_name").alias("known"))
    d = address_classes(spark, sf_dir).join(known, "ip", "left")
    c = F.col("class")
    return d.select("c_custkey", F.when(c == "loopback", "this machine").when(F.col("known").isNotNull(), F.col("known")).when(c == "private", "local network").when(c == "overlay", "overlay network").otherwise(F.col("ip")).alias("name"))


SESSIONS = "(SELECT user_id, event_type, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


@query(
    f"""SELECT user_id, CASE WHEN bool_or(k = 1) THEN 'this check' WHEN bool_or(k = 2) THEN 'VS Code remote' WHEN bool_or(k = 3) THEN 'sftp' WHEN bool_or(k = 4) THEN 'rsync' WHEN user_id % 5 = 0 THEN 'port forwarding only' WHEN count(*) FILTER (k > 50) = 0 THEN 'nothing running'
    WHEN user_id % 2 = 0 THEN 'interactive shell' ELSE 'command: run' || min(k) FILTER (k > 50) END AS what FROM {SESSIONS} GROUP BY user_id"""
)
def session_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session is for, by eight ordered rules over the processes under it."""
    k = F.get_json_object("props", "$.k").cast("long")
    args = F.when(k == 1, "self").when(k == 2, "/home/u/.vscode-server/bin/node").when(k == 3, "/usr/lib/sftp-server").when(k == 4, "rsync -a x y").when(k > 50, F.format_string("run%02d", k))
    p = table(spark, sf_dir, "events").select("user_id", args.alias("args")).groupBy("user_id")
    has = lambda pattern: F.max(F.coalesce(F.col("args").rlike(pattern), F.lit(False)))
    g = p.agg(has("^self$").alias("own"), F.min(text.editor(F.col("args"))).alias("editor"), has("sftp-server").alias("sftp"), F.min(text.copier(F.col("args"))).alias("copy"), F.min(F.when(F.col("args").startswith("run"), F.col("args"))).alias("top"))
    what = F.when(F.col("own"), "this check").when(F.col("editor").isNotNull(), F.concat("editor", F.lit(" remote"))).when(F.col("sftp"), "sftp").when(F.col("copy").isNotNull(), F.col("copy")).when(F.col("user_id") % 5 == 0, "port forwarding only")
    what = what.when(F.col("top").isNull(), "nothing running").when(F.col("user_id") % 2 == 0, "interactive shell").otherwise(F.concat(F.lit("command: "), "top"))
    return g.select("user_id", what.alias("what"))


@query(
    """WITH a AS (SELECT user_id, min(event_id) AS pid FROM events WHERE event_type = 'click' GROUP BY 1), w AS (SELECT user_id, max(event_id) AS tty FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT user_id, coalesce('pid ' || pid, 'tty ' || tty) AS origin, n_name AS key_name FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN a USING (user_id) LEFT JOIN w USING (user_id) LEFT JOIN nation ON n_nationkey = a.user_id % 50"""
)
def session_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their accepted login; those without take the login listing's origin; keys by name where known."""
    e = table(spark, sf_dir, "events")
    a = e.filter("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("pid")).withColumn("key", F.col("user_id") % 50)
    w = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("tty"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("key_name"))
    out = e.select("user_id").distinct().join(a, "user_id", "left").join(w, "user_id", "left").join(names, "key", "left")
    return out.select("user_id", F.coalesce(F.concat(F.lit("pid "), F.col("pid").cast("string")), F.concat(F.lit("tty "), F.col("tty").cast("string"))).alias("origin"), "key_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 + o_orderkey % 3)")
def loose_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections that no session has, by address and port."""
    o = table(spark, sf_dir, "orders").withColumn("port", (1 + F.col("o_orderkey") % 3).cast("int"))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("int").alias("port"))
    return o.join(s, ["o_orderkey", "port"], "left_anti").select("o_orderkey")


@query("SELECT host, count(*) AS n, min(page_id) AS first_id, max(page_id) AS last_id, string_agg(DISTINCT part, ',' ORDER BY part) AS users FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, page_id % 5 AS part FROM pages) GROUP BY host")
def logins_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per address: logins, the first, the last and the users."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host"), (F.col("page_id") % 5).alias("part"))
    users = F.array_join(F.transform(F.array_sort(F.collect_set("part")), lambda x: x.cast("string")), ",")
    return p.groupBy("host").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), users.alias("users"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier WHERE s_acctbal > 0 ORDER BY place LIMIT 10")
def top_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)
    return top.select("s_suppkey", F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("place"))


# a tree of processes: 2 and up, each the child of a third of its number
PROCESSES = """(SELECT event_id + 2 AS pid, (event_id + 2) // 3 AS ppid, user_id, CASE event_id % 23 WHEN 0 THEN 'TMUX: server' WHEN 1 THEN '/lib/systemd --user' WHEN 2 THEN '/h/.cursor-server/bin agent host x' WHEN 3 THEN '/h/.vscode-server/x'
    ELSE 'run the long job number ' || event_id || ' of user ' || user_id END AS args, event_id % 41 = 7 AS opens FROM events)"""


@query(
    f"""WITH RECURSIVE p AS MATERIALIZED {PROCESSES}, c AS (SELECT pid, pid AS anc, ppid AS up, 0 AS depth FROM p UNION ALL SELECT c.pid, p.pid, p.ppid, depth + 1 FROM c JOIN p ON c.up = p.pid),
    a AS (SELECT c.pid, min(anc) FILTER (opens) AS session, bool_or(lower(args) LIKE 'tmux%') FILTER (depth > 0) AS mux, bool_or(args LIKE '%systemd --user%') FILTER (depth > 0) AS usr,
        arg_min(anc, depth) FILTER (depth > 0 AND args LIKE '%.cursor-server/%') AS editor FROM c JOIN p ON p.pid = anc GROUP BY c.pid)
    SELECT p.pid, session, CASE WHEN session IS NOT NULL THEN 'ssh from 10.0.0.' || s.user_id WHEN mux THEN 'tmux/screen' WHEN usr THEN 'systemd user service' WHEN editor IS NOT NULL THEN 'under Cursor pid ' || editor
    WHEN p.ppid = 1 THEN 'detached (parent is init)' ELSE coalesce(q.args[:30], '?') END AS via FROM p JOIN a USING (pid) LEFT JOIN p s ON s.pid = session LEFT JOIN p q ON q.pid = p.ppid"""
)
def process_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each process by the session, multiplexer, service manager, editor or parent that it runs under."""
    e = table(spark, sf_dir, "events")
    kind, pid = F.col("event_id") % 23, F.col("event_id") + 2
    args = F.when(kind == 0, "TMUX: server").when(kind == 1, "/lib/systemd --user").when(kind == 2, "/h/.cursor-server/bin agent host x").when(kind == 3, "/h/.vscode-server/x")
    args = args.otherwise(F.concat(F.lit("run the long job number "), F.col("event_id").cast("string"), F.lit(" of user "), F.col("user_id").cast("string")))
    processes = e.select(pid.alias("pid"), F.floor(pid / 3).alias("ppid"), args.alias("args"))
    sessions = e.filter("event_id % 41 = 7").select(pid.alias("pid"), F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"))
    return hosts.owners(processes, sessions)


@query(
    f"""SELECT ip, CASE s WHEN 'loopback' THEN 'the machine itself' WHEN 'local' THEN 'this machine' WHEN 'peer' THEN n_name WHEN 'endpoint' THEN n_name WHEN 'overlay' THEN coalesce(note, 'an overlay address of no known peer') WHEN 'seen before' THEN n_name WHEN 'note' THEN note
        WHEN 'private' THEN 'unknown' ELSE 'unknown (public address)' END AS name, s AS source FROM (SELECT DISTINCT ip, n_name, CASE WHEN k IN (1, 6) AND n_nationkey % 5 = 0 THEN 'a note on ' || ip WHEN k = 4 AND n_nationkey % 3 = 1 THEN 'a note on ' || ip END AS note,
        CASE WHEN k = 0 THEN 'loopback' WHEN k = 2 AND n_nationkey % 4 = 0 THEN 'local' WHEN k = 5 THEN 'peer' WHEN k = 4 AND n_nationkey % 3 = 0 THEN 'endpoint' WHEN k IN (1, 5) THEN 'overlay' WHEN k = 3 AND n_nationkey % 2 = 0 THEN 'seen before'
        WHEN (k = 4 AND n_nationkey % 3 = 1) OR (k = 6 AND n_nationkey % 5 = 0) THEN 'note' WHEN k IN (2, 3) THEN 'private' ELSE 'public' END AS s
        FROM (SELECT c_custkey % 8 AS k, {IPS}[1 + c_custkey % 8] AS ip, c_nationkey FROM customer WHERE c_custkey % 8 <> 3 OR c_nationkey < 16) JOIN nation ON n_nationkey = c_nationkey)"""
)
def address_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by nine ordered rules, with where the name comes from."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    s = F.col("k").cast("string")
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    here = n.filter("k % 4 = 0").select(at("192.168.", s, ".1").alias("ip"))
    peers = n.select(at("fd7a:115c:a1e0::", s).alias("ip"), F.col("n_name").alias("peer"), F.when(F.col("k") % 3 == 0, at("8.8.", s, ".8")).alias("endpoint"))
    endpoints = n.filter("k % 2 = 0 AND k < 16").select(at("172.", (F.col("k") + 16).cast("string"), ".0.9").alias("ip"), F.col("n_name").alias("peer"))
    noted = [at("100.", (F.col("k") + 64).cast("string"), ".3.4"), at("host", s)]
    notes = n.filter("k % 5 = 0").select(F.explode(F.array(*noted)).alias("ip")).unionByName(n.filter("k % 3 = 1").select(at("8.8.", s, ".8").alias("ip"))).withColumn("note", F.concat(F.lit("a note on "), "ip"))
    asked = table(spark, sf_dir, "customer").filter("c_custkey % 8 <> 3 OR c_nationkey < 16").select(address().alias("ip"))
    return hosts.named_addresses(asked, here, peers, endpoints, notes)


@query("SELECT user_id % 40 + 100 AS server, arg_min('u' || user_id, (epoch_us(ts), 'u' || user_id)) AS user, count(*) AS panes, min(epoch_us(ts)) AS time FROM events WHERE event_type = 'view' GROUP BY 1")
def pane_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins of a multiplexer's panes, folded to one row for each server."""
    origin = F.when(F.col("event_type") == "view", F.format_string("tmux(%d).%d", F.col("user_id") % 40 + 100, F.col("event_id"))).when(F.col("event_type") == "click", "10.0.0.1")
    e = table(spark, sf_dir, "events")
    return hosts.panes(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), micros("ts").alias("time"), origin.alias("origin")))
