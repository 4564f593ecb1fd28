"""Rules of the importer over whole tables: each row's key picks a case, and the SQL has the answers that the rules ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import rules, titles
from shelfmark.plans.registry import ORACLE, QUERIES, Tables


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return "'{}'".format(value.replace("'", "''")) if isinstance(value, str) else f"{value!r}"


def cases(name: str, table: str, key: str, inputs: str, outputs: str, rows: list[tuple], f) -> None:
    """Registers a query: row k of the table gets case k mod n, f(case) -> struct of the outputs; rows: (*inputs, *outputs)."""
    ins, outs = ([x.split() for x in s.split(", ")] for s in (inputs, outputs))

    def lit(value, kind: str) -> Column:
        return F.array(*map(F.lit, value)).cast(kind) if isinstance(value, list) else F.lit(value).cast(kind)

    def run(spark, sf_dir) -> DataFrame:
        given = F.array(*(F.struct(*(lit(v, k).alias(n) for v, (n, k) in zip(row, ins, strict=False))) for row in rows))
        picked = getattr(Tables(spark, sf_dir), table).select(key, F.get(given, F.pmod(F.col(key), F.lit(len(rows))).cast("int")).alias("c"))
        return picked.select(key, F.explode(F.array(f(F.col("c")))).alias("o")).select(key, *(F.col(f"o.{n}").cast(k).alias(n) for n, k in outs))

    if name in QUERIES:
        raise ValueError(f"two queries are named {name}")
    kinds = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    answers = ", ".join(f"({', '.join(map(_sql, (i, *row[len(ins):])))})" for i, row in enumerate(rows))
    chosen = ", ".join(f"CAST(a.{n} AS {kinds[k]}) AS {n}" for n, k in outs)
    QUERIES[name] = run
    ORACLE[name] = f"SELECT {key}, {chosen} FROM {table} JOIN (VALUES {answers}) a(i, {', '.join(n for n, _ in outs)}) ON {key} % {len(rows)} = a.i"


def _retry(c: Column) -> Column:
    code = rules.error_code(c["status"], c["message"], c["raiser"], c["stage"])
    d = rules.retry_decision(code, c["attempts"], c["most"], c["after"], c["message"])
    return F.struct(code.alias("code"), d["decision"].alias("decision"), d["wait_s"].alias("wait_s"))


cases(
    "retry_decision", "events", "event_id", "status int, message string, raiser string, stage string, attempts int, most int, after int", "code string, decision string, wait_s int",
    [
        (None, "no chapters in record", "PermanentDataError", None, 0, 7, None, "PERMANENT_DATA_ERROR", "FAILED", 0),
        (None, "Formato não permitido", None, None, 1, 7, None, "INVALID_MEDIA", "RETRY", 30),
        (200, "not a valid image", None, None, 3, 7, None, "INVALID_MEDIA", "FAILED", 0),
        (None, "PERMANENT_404_UNRESOLVED page 3", None, None, 0, 7, None, "IMAGE_404", "FAILED", 0),
        (None, "source returned 0 pages", None, None, 1, 7, None, "EMPTY_PAGES", "RETRY", 30),
        (None, "Incomplete chapter import", None, None, 2, 7, None, "EMPTY_PAGES", "FAILED", 0),
        (None, "Lease expired for task", None, None, 2, 7, None, "LEASE_EXPIRED", "RETRY", 60),
        (None, "JobExecutionTimeout", None, None, 2, 2, None, "WORKER_STALL", "FAILED", 0),
        (None, "circuit breaker OPEN for host", None, None, 4, 7, None, "CIRCUIT_BREAKER_OPEN", "RETRY", 240),
        (None, "UPSTREAM_BLOCKED: No fallbacks", None, None, 5, 7, None, "CIRCUIT_BREAKER_OPEN", "FAILED", 0),
        (None, "Source abc is PAUSED", None, None, 5, None, None, "SOURCE_PAUSED", "RETRY", 300),
        (429, "slow down", None, "storage", 1, 7, 25, "TELEGRAM_RATE_LIMIT", "RETRY", 25),
        (503, "bridge", None, "storage", 3, 7, None, "TELEGRAM_TRANSIENT", "RETRY", 120),
        (401, "bad key", None, "storage", 0, 7, None, "PERMANENT_NOT_FOUND", "FAILED", 0),
        (500, "something", None, "storage", 5, 7, None, "TELEGRAM_TRANSIENT", "RETRY", 300),
        (404, "gone", "ProviderDownloadError", None, 1, 7, None, "IMAGE_404", "RETRY", 30),
        (403, "no", "ProviderDownloadError", None, 2, 7, None, "SOURCE_403", "FAILED", 0),
        (429, "no", "ProviderDownloadError", None, 4, 7, None, "SOURCE_429", "RETRY", 60),
        (520, "edge", "ProviderDownloadError", None, 3, 7, None, "SOURCE_5XX", "RETRY", 120),
        (0, "socket closed", "ProviderDownloadError", None, 1, 7, None, "SOURCE_TIMEOUT", "RETRY", 30),
        (None, "deadlock detected", None, None, 4, 7, None, "DB_TRANSIENT", "RETRY", 240),
        (None, "deadlock detected", None, None, 5, 7, None, "DB_TRANSIENT", "FAILED", 0),
        (429, "upload refused", None, None, 2, 7, 9000, "TELEGRAM_RATE_LIMIT", "RETRY", 3600),
        (None, "rate limit", None, None, 1, 7, None, "SOURCE_429", "RETRY", 60),
        (None, "ETIMEDOUT cdn", None, None, 2, 7, None, "IMAGE_TIMEOUT", "RETRY", 60),
        (None, "ECONNRESET", None, "provider", 2, 7, None, "SOURCE_TIMEOUT", "RETRY", 60),
        (None, "operation aborted", None, None, 6, 7, None, "TRANSIENT_NETWORK", "FAILED", 0),
        (404, "work", None, None, 1, 7, None, "SOURCE_404", "RETRY", 30),
        (None, "HTTP 404 for image", None, None, 2, 7, None, "IMAGE_404", "FAILED", 0),
        (403, "denied", None, None, 1, 7, None, "SOURCE_403", "RETRY", 30),
        (None, "Forbidden by storage", None, None, 0, 7, None, "PERMANENT_NOT_FOUND", "FAILED", 0),
        (None, "Unexpected token <", None, None, 1, 7, None, "PARSER_ERROR", "RETRY", 30),
        (None, "something odd", None, None, 5, 9, None, "TRANSIENT_NETWORK", "RETRY", 300),
        (None, None, None, None, 0, 7, None, "TRANSIENT_NETWORK", "RETRY", 300),
    ],
    _retry,
)
cases(
    "block_class", "pages", "page_id", "status int, server string, ray string, after int, kind string, body string, expected string", "class string",
    [
        (200, None, None, None, "text/html", "<html>fine", "html", None), (403, "cloudflare", None, None, None, "no", "html", "CLOUDFLARE_DATACENTER_BLOCK"), (403, None, "8a1", None, None, "no", "html", "CLOUDFLARE_DATACENTER_BLOCK"),
        (403, "nginx", None, None, None, "no", "html", "UNKNOWN_CLOUDFLARE"), (403, "nginx", None, 30, None, "no", "html", "RATE_LIMITED"), (429, None, None, None, None, "", "json", "RATE_LIMITED"),
        (200, None, None, None, "text/html", "<div class=cf-turnstile>", "html", "TURNSTILE"), (503, None, None, None, None, "Just a moment...", "html", "JS_CHALLENGE"), (503, None, None, None, None, "down", "html", None),
        (200, None, None, None, "text/html", "<html>", "json", "UNKNOWN_CLOUDFLARE"), (403, None, None, None, "application/json", "{}", "json", "API_BLOCK"), (403, None, None, None, "image/png", "", "image", "IMAGE_CDN_BLOCK"),
        (200, None, None, None, "image/png", "", "image", None), (200, None, None, None, None, "<!DOCTYPE html>", "image", "UNKNOWN_CLOUDFLARE"), (404, None, None, None, "text/html", "x", "json", "API_BLOCK"),
        (200, "hcdn", None, None, "text/html", "/hcdn-cgi/jschallenge-validate", "html", "JS_CHALLENGE"), (503, None, None, None, "text/html", "", "image", "TEMPORARY_WAF"), (500, "cloudflare", None, None, None, "error", "html", None),
    ],
    lambda c: F.struct(rules.block_class(c["status"], c["server"], c["ray"], c["after"], c["kind"], c["body"], c["expected"]).alias("class")),
)
cases(
    "sql_fingerprint", "nation", "n_nationkey", "statement string", "fingerprint string",
    [
        ("/* app-sql:Claim_Next */ SELECT 1", "OP claim_next"), ("select * from public.importer_acquire($1)", "SELECT rpc:importer_acquire"), ("SELECT importer_renew ( $1 )", "SELECT rpc:importer_renew"), ('SELECT "a" FROM "public"."Works" WHERE id = 1', "SELECT works"),
        ("  UPDATE\n chapters SET a = 1", "UPDATE chapters"), ("INSERT INTO public.tasks (a) VALUES (1)", "INSERT tasks"), ("DELETE FROM old_rows", "DELETE old_rows"), ("BEGIN", "BEGIN"), ("WITH x AS (SELECT 1 FROM a) SELECT * FROM b", "WITH a"), ("", "UNKNOWN"), (None, "UNKNOWN"), ("SELECT now()", "SELECT"),
    ],
    lambda c: F.struct(rules.sql_fingerprint(c["statement"]).alias("fingerprint")),
)
cases(
    "url_class", "pages", "page_id", "url string, place int, total int", "class string",
    [
        ("https://a.org/Credits.jpg", 3, 9, "CREDIT_PAGE"), ("https://a.org/cr%C3%A9dito.png", 3, 9, "CREDIT_PAGE"), ("https://a.org/recrutamento-1.png", 8, 9, "RECRUITMENT_PAGE"), ("https://a.org/aviso.png", 1, 9, "WARNING_PAGE"), ("https://a.org/apoie.png", 4, 9, "PROMO_PAGE"),
        ("https://a.org/capa.png", 0, 9, "CREDIT_PAGE"), ("https://a.org/capa.png", 1, 9, "CONTENT_PAGE"), ("https://a.org/000.png", 0, 9, "CREDIT_PAGE"), ("https://a.org/staff.png", 8, 9, "PROMO_PAGE"), ("https://a.org/staff.png", 4, 9, "CONTENT_PAGE"), ("https://a.org/[group] name (0).png", 0, 9, "CREDIT_PAGE"),
        ("https://a.org/100%.png", 4, 9, "CONTENT_PAGE"), (None, 0, 1, "CONTENT_PAGE"),
    ],
    lambda c: F.struct(rules.page_class(c["url"], c["place"], c["total"]).alias("class")),
)
cases(
    "title_validation", "pages", "page_id", "title string", "verdict string",
    [
        (None, "EMPTY"), ("  ", "EMPTY"), ("[...]", "EMPTY"), ("&nbsp;", "EMPTY"), ("x" * 251, "TOO_LONG"), ("x" * 250, "OK"), ("Log in", "LOGIN_WALL"), ("The Login of Kings", "OK"), ("Entrar na conta", "LOGIN_WALL"), ("Just a moment...", "CHALLENGE"), ("Attention Required! | x", "CHALLENGE"),
        ("404", "HTTP_ERROR"), ("503 Service Unavailable", "HTTP_ERROR"), ("4040 Days", "OK"), ("Página não encontrada", "HTTP_ERROR"), ("Not found", "HTTP_ERROR"), ("Lost and not found", "OK"), ("undefined", "PLACEHOLDER"), ("Sem t&iacute;tulo", "OK"), ("Sem título", "PLACEHOLDER"), ("86", "OK"), ("&#49;&#x30;1", "OK"), ("犬夜叉", "OK"),
    ],
    lambda c: F.struct(rules.title_verdict(c["title"]).alias("verdict")),
)
cases(
    "tag_normalize", "events", "event_id", "raw array<string>", "tags string",
    [
        (["Action", "action", "AÇÃO"], "Ação"), (["Boy's Love", "boys-love", "BL"], "Yaoi"), (["sci_fi", "Science  Fiction"], "Sci-Fi"), (["Manga", "Completo", "drama"], "Drama"), (["+18", "Mature", "Adulto (+18)"], "Adulto (+18)"), (["ntr", "netorare"], "NTR|Netorare"),
        (["Slice Of Life", "COMEDY &amp; fun"], "Slice of life|Comedy & fun"), (["leia no nosso site!", ""], ""), ([], ""), (["Girls' Love", None, "gl"], "Yuri"),
    ],
    lambda c: F.struct(F.array_join(rules.normal_tags(c["raw"]), "|").alias("tags")),
)
cases(
    "alias_bucket", "part", "p_partkey", "title string, aliases array<string>", "bucket int",
    [
        ("Anything", [], 1), ("Anything", ["One"], 2), ("A Lição do Herói", ["Coração de Ferro", "A maldição"], 3), ("A Lição do Herói", ["Coração de Ferro", "Iron Heart"], 5), ("Iron Heart", ["Ironheart", "アイアン"], 4), ("Iron Heart", ["Coração de Ferro", "x y"], 5),
        ("El Dragón", ["a b", "c d"], 4), ("A filha do duque e o marido", ["O retorno do rei e a espada", "A noite do caçador"], 3), ("犬", ["いぬ", "Dog"], 4), ("Title", None, 1),
    ],
    lambda c: F.struct(rules.alias_bucket(c["title"], c["aliases"]).alias("bucket")),
)
cases(
    "chapter_identity", "lineitem", "l_orderkey", "number string, title string, kind string, language string, edition string", "key string, kind string, order_key string, again string",
    [
        ("12.00", "Any title", None, "pt-BR", None, "pt-br|default|chapter|12|-", "chapter", "n|000000000012|000000000000|00||any%20title", "12"), ("12.10", None, None, None, "", "und|default|chapter|12.10|-", "chapter", "n|000000000012|100000000000|10||", "12.10"),
        ("12.1", None, None, None, None, "und|default|chapter|12.1|-", "chapter", "n|000000000012|100000000000|1||", "12.1"), ("3.0", "Special: A|B", None, "en", "v2", "en|v2|special|3.0|special%3A%20a%7Cb", "special", "n|000000000003|000000000000|0||special%3A%20a%7Cb", "3.0"),
        (None, "Prólogo", None, "pt", None, "pt|default|special|unnumbered|pr%C3%B3logo", "special", "z||pr%C3%B3logo", ""), ("7b", None, "Extra", None, None, "und|default|extra|7b|-", "extra", "n|000000000007|000000000000||b|", "7b"), ("", "", None, None, None, None, None, None, None),
        ("(a)!~*'", None, "x", None, None, "und|default|x|(a)!~*'|-", "x", "z|(a)!~*'|", "(a)!~*'"),
    ],
    # behind a lambda, so that the identity is made once
    lambda c: F.transform(F.array(rules.chapter_identity(c["number"], c["title"], c["kind"], c["language"], c["edition"])), lambda i: F.struct(i["key"].alias("key"), i["kind"].alias("kind"), i["order_key"].alias("order_key"), rules.parse_chapter_key(i["key"])["number"].alias("again")))[0],
)
cases(
    "identity_guards", "part", "p_partkey", "title string, type string", "novel boolean, pack boolean, adult boolean, season string, side boolean",
    [
        ("Solo Leveling (Novel)", None, True, False, False, None, False), ("Solo Leveling", "light novel", True, False, False, None, False), ("Pack de Imagens X", None, False, True, False, None, False), ("X Doujinshi", None, False, False, True, None, False), ("Tower of God Season 2", None, False, False, False, "2", False),
        ("Tower 3ª Temporada", None, False, False, False, "3", False), ("Tower Season IV", None, False, False, False, "4", False), ("Eleceed Side Story", None, False, False, False, None, True), ("História Paralela", None, False, False, False, None, True), ("Novelty", None, False, False, False, None, False), (None, None, False, False, False, None, False),
    ],
    lambda c: F.struct(*((g := titles.guards(c["title"], c["type"]))[k].alias(k) for k in ("novel", "pack", "adult", "season", "side"))),
)
