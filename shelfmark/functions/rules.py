"""Rules of an importer as Columns: errors and retries, upstream blocks, titles, tags, aliases, chapter identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attempts that an error of each kind may have.
BUDGETS = {
    "PERMANENT_NOT_FOUND": 1, "IMAGE_404": 2, "EMPTY_PAGES": 2, "PARSER_ERROR": 2, "SOURCE_404": 2, "SOURCE_403": 2, "INVALID_MEDIA": 3, "PERMANENT_DATA_ERROR": 1, "LEASE_EXPIRED": 3, "WORKER_STALL": 3, "DB_TRANSIENT": 5,
    "SOURCE_429": 5, "SOURCE_5XX": 5, "SOURCE_TIMEOUT": 5, "IMAGE_TIMEOUT": 5, "CIRCUIT_BREAKER_OPEN": 5, "TRANSIENT_NETWORK": 6, "TELEGRAM_TRANSIENT": 6, "TELEGRAM_RATE_LIMIT": 6, "SOURCE_PAUSED": 10, "RETRY_BUDGET_EXHAUSTED": 0, "UNKNOWN": 4,
}
#: Attempts that no error may exceed; seconds before attempts 2, 3, ...; the longest wait.
MOST, WAITS, LONGEST = 7, (30, 60, 120, 240), 300


def _first(rules: list[tuple[Column, Column | str]], otherwise: Column | str) -> Column:
    """The value of the first rule that holds; one that is null doesn't."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return reduce(lambda out, r: F.when(F.coalesce(r[0], F.lit(False)), lit(r[1])).otherwise(out), reversed(rules), lit(otherwise))


def error_code(status: Column, message: Column, name: Column, stage: Column) -> Column:
    """What kind of error it is, by the raiser's name and stage, the HTTP status, and the message; in this order."""
    m = F.coalesce(message, F.lit(""))
    has = lambda p: m.rlike(f"(?i){p}")
    storage = _first([((status == 429) | has(r"429|rate\s*limit|floodwait"), "TELEGRAM_RATE_LIMIT"), (status.isin(502, 503) | has("502|503"), "TELEGRAM_TRANSIENT"), (status.isin(401, 403) | has("unauthorized|forbidden"), "PERMANENT_NOT_FOUND")], "TELEGRAM_TRANSIENT")
    download = _first([((status == 404) | has("404|not found"), "IMAGE_404"), ((status == 403) | has("403|forbidden|cloudflare"), "SOURCE_403"), ((status == 429) | has(r"429|rate\s*limit"), "SOURCE_429"), (status >= 500, "SOURCE_5XX")], "SOURCE_TIMEOUT")
    return _first(
        [
            (name == "PermanentDataError", "PERMANENT_DATA_ERROR"),
            ((name == "InvalidMediaError") | has("Formato n[ãa]o permitido|invalid media|not a valid image|unsupported image format"), "INVALID_MEDIA"),
            (has("PERMANENT_404_UNRESOLVED"), "IMAGE_404"),
            (has("failed to return pages|returned 0 pages|0 valid content pages|incomplete chapter import"), "EMPTY_PAGES"),
            (has("Lease expired|worker unresponsive"), "LEASE_EXPIRED"),
            (has("JobExecutionTimeout|exceeded safety limit"), "WORKER_STALL"),
            (has("circuit breaker OPEN|UPSTREAM_BLOCKED.*No fallbacks"), "CIRCUIT_BREAKER_OPEN"),
            (has("Source .* is (PAUSED|DISABLED)"), "SOURCE_PAUSED"),
            (stage == "storage", storage),
            (name == "ProviderDownloadError", download),
            (has("yugabyte|ysql|deadlock|serialization failure|terminating connection|connection terminated"), "DB_TRANSIENT"),
            ((status == 429) | has(r"429|rate\s*limit|floodwait"), F.when(has("telegram|storage|worker|upload|media"), "TELEGRAM_RATE_LIMIT").otherwise("SOURCE_429")),
            (has("timeout|aborted|ETIMEDOUT|ECONNRESET"), F.when(has("image|page|story|cdn"), "IMAGE_TIMEOUT").when(F.coalesce(stage == "provider", F.lit(False)), "SOURCE_TIMEOUT").otherwise("TRANSIENT_NETWORK")),
            ((status == 404) | has("404 Not Found|status: 404|HTTP 404"), F.when(has("image|page|narrative|cdn"), "IMAGE_404").otherwise("SOURCE_404")),
            (status.isin(401, 403) | has("unauthorized|forbidden"), F.when(has("storage|telegram|worker"), "PERMANENT_NOT_FOUND").otherwise("SOURCE_403")),
            (has(r"SyntaxError|JSON\.parse|unexpected token"), "PARSER_ERROR"),
        ],
        "TRANSIENT_NETWORK",
    )


def retry_decision(code: Column, attempts: Column, most: Column, retry_after: Column, message: Column) -> Column:
    """(decision, wait_s) after so many attempts: FAILED beyond the kind's budget, else RETRY after the wait (no jitter).

    Rate limits wait as long as they say, 60 s if they don't; others 30, 60, 120, 240 and then 300 s.
    """
    budgets = F.create_map(*(F.lit(x) for pair in BUDGETS.items() for x in pair))
    budget = F.least(F.greatest(F.lit(1), F.coalesce(most, F.lit(MOST))), F.coalesce(budgets[code], F.lit(MOST)), F.lit(MOST))
    fatal = code.isin("PERMANENT_DATA_ERROR", "PERMANENT_NOT_FOUND") | F.coalesce(message, F.lit("")).rlike("(?i)PERMANENT_404_UNRESOLVED")
    limited = code.isin("SOURCE_429", "TELEGRAM_RATE_LIMIT")
    waits = F.coalesce(F.get(F.array(*map(F.lit, WAITS)), attempts - 1), F.lit(LONGEST))
    after = F.coalesce(F.when(retry_after > 0, F.least(F.lit(3600), retry_after)), F.lit(60))
    failed = fatal | (attempts >= budget)
    return F.struct(F.when(failed, "FAILED").otherwise("RETRY").alias("decision"), F.when(failed, 0).when(limited, after).otherwise(waits).cast("int").alias("wait_s"))


# What a challenge page holds.
CHALLENGE = ("just a moment...", "cf-browser-verification", "/cdn-cgi/challenge-platform", "cf-turnstile", "turnstile.render", "/hcdn-cgi/jschallenge-validate", "challenge-form")
TURNSTILE = ("cf-turnstile", "turnstile.render", "challenges.cloudflare.com/turnstile")
SCRIPT = ("/cdn-cgi/challenge-platform", "cf-browser-verification", "/hcdn-cgi/jschallenge-validate")


def block_class(status: Column, server: Column, ray: Column, retry_after: Column, content_type: Column, body: Column, expected: Column) -> Column:
    """Why an upstream refused: null if it didn't. expected: json, image or html."""
    b, kind, host = (F.lower(F.coalesce(c, F.lit(""))) for c in (body, content_type, server))
    any_of = lambda words: reduce(lambda p, q: p | q, (F.contains(b, F.lit(w)) for w in words))
    cloudflare = F.contains(host, F.lit("cloudflare")) | F.coalesce(ray != "", F.lit(False)) | F.contains(host, F.lit("hcdn")) | F.contains(b, F.lit("cloudflare"))
    signs, turnstile = any_of(CHALLENGE), any_of(TURNSTILE)
    script = any_of(SCRIPT) | (signs & ~turnstile)
    html = F.contains(kind, F.lit("text/html")) | F.startswith(b, F.lit("<!doctype")) | F.startswith(b, F.lit("<html")) | F.contains(b, F.lit("<title>"))
    image = ~html & (F.startswith(kind, F.lit("image/")) | (kind == ""))
    fake = F.when(expected == "image", html | signs | ~image).when(expected == "json", F.contains(kind, F.lit("text/html")) | signs).otherwise(False)
    refused = status.isin(403, 429) | ((status == 503) & signs) | fake
    why = _first(
        [
            (turnstile, "TURNSTILE"), (script, "JS_CHALLENGE"), ((status == 429) | ((status == 403) & (retry_after > 0)), "RATE_LIMITED"), ((expected == "image") & (status == 403), "IMAGE_CDN_BLOCK"),
            ((expected == "json") & status.isin(403, 404), "API_BLOCK"), (status == 503, "TEMPORARY_WAF"), ((status == 403) & cloudflare, "CLOUDFLARE_DATACENTER_BLOCK"),
        ],
        "UNKNOWN_CLOUDFLARE",
    )
    return F.when(refused | signs | turnstile | script, why)


def sql_fingerprint(statement: Column) -> Column:
    """A statement without its values: the operation that its comment names, else the procedure or verb and table."""
    s = F.trim(F.regexp_replace(F.coalesce(statement, F.lit("")), r"\s+", " "))
    found = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    named, verb = found(r"(?i)^/\*\s*[a-z]+-sql:([a-z0-9_-]{1,64})\s*\*/"), F.coalesce(F.upper(found(r"(?i)^([A-Z]+)")), F.lit("UNKNOWN"))
    procedure = found(r"(?i)^SELECT\s+(?:\*\s+FROM\s+)?(?:public\.)?(importer_[a-z0-9_]*)\s*\(")
    table = found(r'(?i)\b(?:FROM|INTO|UPDATE|DELETE\s+FROM)\s+(?:"?public"?\.)?"?([a-z_][a-z0-9_]*)"?')
    return F.coalesce(F.concat(F.lit("OP "), F.lower(named)), F.concat(F.lit("SELECT rpc:"), procedure), F.concat_ws(" ", verb, F.lower(table)))


def page_class(url: Column, index: Column, total: Column) -> Column:
    """What a chapter's page shows, by its URL and place: content, credits, recruitment, warnings, promotion."""
    u = F.lower(F.coalesce(F.try_url_decode(url), url, F.lit("")))
    has = lambda p: u.rlike(p)
    return _first(
        [
            (has("credito|crédito|credit"), "CREDIT_PAGE"), (has("recrut|recruit"), "RECRUITMENT_PAGE"), (has("aviso|warning|notice"), "WARNING_PAGE"), (has("fanservice|apoie|doacao|doação|donate|discord|parceria"), "PROMO_PAGE"),
            ((index == 0) & has(r"capa|cover|front|\(0+\)|\b000?\b|_00\.|\[.+\]\s*.+\(0\)"), "CREDIT_PAGE"), (((index == 0) | (index == total - 1)) & has("scan|staff|discord|padrim|apoia"), "PROMO_PAGE"),
        ],
        "CONTENT_PAGE",
    )


# HTML entities that titles and texts hold by name.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "copy": "©", "reg": "®", "middot": "·", "bull": "•", "eacute": "é", "ccedil": "ç", "atilde": "ã", "otilde": "õ"}


def decode_entities(c: Column) -> Column:
    """Named entities of ENTITIES, and decimal and hexadecimal ones, as characters; & itself last."""
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    number = lambda d: F.when(F.startswith(d, F.lit("x")) | F.startswith(d, F.lit("X")), F.conv(F.substring(d, F.lit(2), F.length(d)), 16, 10).cast("long")).otherwise(d.try_cast("long"))
    # code points beyond 255 by their UTF-8 bytes
    byte = lambda n: F.lpad(F.hex(n.cast("long")), 2, "0")
    tail = lambda n, shift: byte(F.lit(128) + F.floor(n / (1 << shift)) % 64)

    def char(n):
        one, two, three = byte(n), F.concat(byte(F.lit(192) + F.floor(n / 64)), tail(n, 0)), F.concat(byte(F.lit(224) + F.floor(n / 4096)), tail(n, 6), tail(n, 0))
        four = F.concat(byte(F.lit(240) + F.floor(n / 262144)), tail(n, 12), tail(n, 6), tail(n, 0))
        return F.decode(F.unhex(F.when(n < 128, one).when(n < 2048, two).when(n < 65536, three).otherwise(four)), "UTF-8")

    pieces, codes = F.split(c, "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.regexp_extract_all(c, F.lit("&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(1))
    joined = F.array_join(F.zip_with(pieces, codes, lambda p, d: F.concat(p, F.when(d.isNull(), "").when(number(d).between(1, 1114111), char(number(d))).otherwise(" "))), "")
    return F.replace(F.when(F.contains(c, F.lit("&#")), joined).otherwise(c), F.lit("&amp;"), F.lit("&"))


def title_verdict(title: Column) -> Column:
    """Whether a title may stand: OK, or what it is instead; whole titles are judged, not words in them."""
    t = F.trim(decode_entities(F.coalesce(title, F.lit(""))))
    low = F.lower(t)
    return _first(
        [
            ((t == "") | t.rlike(r"^[\s\[\](){}\-_.,:;!?/'\"\\|~+*#@$%^&=>`<´]+$"), "EMPTY"), (F.length(t) > 250, "TOO_LONG"),
            (low.rlike(r"^(entrar(\s+na\s+conta)?|login|log\s*in|sign\s*in|fazer\s+login|cadastre-se|minha\s+conta|criar\s+conta|autentica[çc][ãa]o)$"), "LOGIN_WALL"),
            (low.rlike("cloudflare|just a moment|attention required|checking your browser|ray id|turnstile|verify you are human|bot detection|ddos-guard"), "CHALLENGE"),
            (low.rlike(r"^(40[0-9]|50[0-9])(\s+.*)?$|^(erro\s*(40[0-9]|50[0-9])?|not found|forbidden|access denied|bad gateway|internal server error|page not found|p[aá]gina n[aã]o encontrada)$"), "HTTP_ERROR"),
            (low.rlike(r"^(untitled|sem t[ií]tulo|unknown title|undefined|null|nan)$"), "PLACEHOLDER"),
        ],
        "OK",
    )


# Tags by their other names, tags that keep their own spelling, names of the adult rating, and what is no tag.
TAGS = {
    "bl": "Yaoi", "boys love": "Yaoi", "shounen ai": "Yaoi", "shonen ai": "Yaoi", "gl": "Yuri", "girls love": "Yuri", "shoujo ai": "Yuri", "shojo ai": "Yuri", "pornhwa": "Pornhwa", "porn hwa": "Pornhwa", "action": "Ação",
    "adventure": "Aventura", "comedy": "Comédia", "fantasy": "Fantasia", "horror": "Terror", "psychological": "Psicológico", "reincarnation": "Reencarnação", "supernatural": "Sobrenatural", "slice of life": "Slice of life",
    "sci fi": "Sci-Fi", "science fiction": "Sci-Fi", "martial arts": "Artes marciais", "school life": "Escolar", "mystery": "Mistério", "thriller": "Suspense",
    "milf": "MILF", "bdsm": "BDSM", "ntr": "NTR", "netorare": "Netorare", "netorase": "Netorase", "netori": "Netori", "vanilla": "Vanilla", "hentai": "Hentai", "ecchi": "Ecchi", "yuri": "Yuri", "yaoi": "Yaoi", "harem": "Harem", "anal": "Anal",
    **dict.fromkeys(("adulto", "+18", "18+", "adult", "adulto +18", "adulto (+18)", "adults only", "mature"), "Adulto (+18)"),
}
NO_TAGS = ("completo", "em andamento", "em lancamento", "em lançamento", "cancelado", "hiato", "lancamento", "manga", "manhwa", "manhua", "webtoon", "comic", "doujinshi")
PAGE_WORDS = ("leia no nosso site", "atualizacao", "atualização", "projeto da scan")


def normal_tag(raw: Column) -> Column:
    """The catalogue's name of a tag; null for what is no tag."""
    t = F.trim(F.regexp_replace(decode_entities(raw), r"\s+", " "))
    key = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(t), "[’']", ""), "[-_]+", " "), r"\s+", " "))
    names = F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair))
    other = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))
    garbage = F.lower(t).isin(*NO_TAGS) | reduce(lambda p, q: p | q, (F.contains(F.lower(t), F.lit(w)) for w in PAGE_WORDS))
    return F.when(~garbage & (t != ""), F.coalesce(names[key], other))


def normal_tags(raw: Column) -> Column:
    """Names of tags without repeats, the first place stays."""
    return F.array_distinct(F.filter(F.transform(raw, normal_tag), lambda t: t.isNotNull()))


# Words of Portuguese titles, those that are content, and what shows another language.
PORTUGUESE = "o os um uma do da dos das no na nos nas pelo pela pelos pelas meu minha meus minhas seu sua seus suas nao não sem mais como quando apos após ate até entre contra sobre irma irmã irmao irmão marido esposa noiva noivo namorada namorado vila vilã vilao vilão heroi herói heroina heroína principe príncipe princesa duque duquesa imperador imperatriz rei rainha deus deusa demonio demônio dragao dragão torre fazendeiro unico único unica única cacador caçador cacadora caçadora espada feiticeiro feiticeira mago academia escola garota garoto menino menina mulher homem segredo vinganca vingança mundo vida morte noite retorno regresso reencarnacao reencarnação nivel nível mestre discipulo discípulo sombrio sangrento divino supremo lendario lendário maldito doce amor coracao coração familia família filha filho mae mãe pai crônicas cronicas lenda sombras luz guerreiro".split()
CONTENT = "não irma irmã irmao irmão marido esposa noiva noivo namorada namorado vilã vilão herói heroína príncipe princesa duque duquesa imperador imperatriz rainha demônio dragão torre fazendeiro único única caçador caçadora espada feiticeiro feiticeira garota garoto menino menina mulher homem segredo vingança morte noite retorno regresso reencarnação nível discípulo sombrio sangrento lendário maldito doce coração família filha filho mãe guerreiro".split()
CJK = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{AC00}-\\x{D7AF}]"
OTHER_SCRIPT = "[\\x{0400}-\\x{052F}\\x{0530}-\\x{058F}\\x{0590}-\\x{05FF}\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{0900}-\\x{0DFF}\\x{0E00}-\\x{0E7F}\\x{1000}-\\x{10FF}]|(?iu)[α-ωάέήίόύώ]{4,}"
SPANISH = r"(?iu)[ñ¿¡]|^la\s+|(?<![\p{L}\p{N}\-])(?:el|los|las|del|una|unos|unas|hacia|también|después|pero|joven|jóvenes|corazón|dragón|prisión|traición|reencarnación|maldición|canción|pasión|habitación|educación|tentación|obsesión|redención|salvación|en\s+el|en\s+la|de\s+la|con\s+el|con\s+la|a\s+solas|mi\s+hermana|mi\s+esposa|nella|della|degli|delle|nello|ragazza|dans|avec|pour|une|château)(?![\p{L}\p{N}])"
STRONG = r"(?iu)[ãõç]|(?U)\b\p{L}+(?:ção|ções|nho|nha|lh[ao]s?|íssim[ao])\b"


def portuguese(title: Column) -> Column:
    """Whether a title is Portuguese: by letters and endings that only it has, else by its words."""
    t = F.trim(F.regexp_replace(decode_entities(F.coalesce(title, F.lit(""))), r"\s+", " "))
    words = F.filter(F.split(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: w != "")
    distinct_hits = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    hits, content = distinct_hits(PORTUGUESE), distinct_hits(CONTENT)
    by_words = (F.size(words) >= 2) & (((hits >= 3) & (content >= 1)) | ((hits >= 2) & (content >= 2)))
    return (t != "") & ~t.rlike(CJK) & ~t.rlike(OTHER_SCRIPT) & ~t.rlike(SPANISH) & (t.rlike(STRONG) | by_words)


def alias_bucket(title: Column, aliases: Column) -> Column:
    """How urgently a work needs other titles: 1 none, 2 one, 3 no international one, 4 no Portuguese one, 5 the rest."""
    own = portuguese(title)
    abroad = F.exists(aliases, lambda a: a.rlike(CJK) | ~portuguese(a))
    home = own | F.exists(aliases, portuguese)
    n = F.coalesce(F.size(aliases), F.lit(0))
    return F.when(n <= 0, 1).when(n == 1, 2).when(own & ~abroad, 3).when(~own & ~home, 4).otherwise(5)


def _encoded(c: Column) -> Column:
    """Percent-encoded as in a URI component: letters, digits and -_.!~*'() stay."""
    e = F.url_encode(c)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(code), F.lit(char))
    return e


def chapter_identity(number: Column, title: Column, kind: Column, language: Column, edition: Column) -> Column:
    """(key, kind, order_key) of a chapter: 12.00 is 12, 12.10 isn't 12.1; null without number and title.

    Numbers are text throughout. Chapters of a number are the same under any title; specials keep theirs.
    """
    text = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    t, raw, own = text(title), text(number), text(kind)
    what = F.when(own != "", own).when(t.rlike("extra|especial|special|omake|prologue|pr[oó]logo|side"), "special").otherwise("chapter")
    shown = F.when(what == "chapter", F.regexp_replace(raw, r"^(\d+)\.0+$", "$1")).otherwise(raw)
    name = F.when((shown == "") | (what != "chapter"), F.coalesce(F.nullif(t, F.lit("")), F.lit("-"))).otherwise("-")
    or_ = lambda c, d: F.coalesce(F.nullif(text(c), F.lit("")), F.lit(d))
    key = F.concat_ws("|", *map(_encoded, (or_(language, "und"), or_(edition, "default"), what, F.coalesce(F.nullif(shown, F.lit("")), F.lit("unnumbered")), name)))
    at = r"^(\d+)(?:\.(\d+))?(.*)$"
    part = F.regexp_extract(raw, at, 2)
    order = F.concat_ws("|", F.lit("n"), F.lpad(F.regexp_extract(raw, at, 1), 12, "0"), F.rpad(F.substring(part, 1, 12), 12, "0"), part, _encoded(F.trim(F.regexp_extract(raw, at, 3))), _encoded(t))
    last = F.concat_ws("|", F.lit("z"), _encoded(raw), _encoded(t))
    return F.when((shown != "") | (t != ""), F.struct(key.alias("key"), what.alias("kind"), F.when(raw.rlike(r"^\d"), order).otherwise(last).alias("order_key")))


def parse_chapter_key(key: Column) -> Column:
    """(language, edition, kind, number, title) of a chapter's key; null for what is none."""
    parts = F.split(key, r"\|", -1)
    names = ("language", "edition", "kind", "number", "title")
    made = {n: F.try_url_decode(F.replace(F.get(parts, F.lit(i)), F.lit("+"), F.lit("%2B"))) for i, n in enumerate(names)}
    empty = {"number": "unnumbered", "title": "-"}
    out = F.struct(*(F.when(made[n] == empty[n], "").otherwise(made[n]).alias(n) if n in empty else made[n].alias(n) for n in names))
    sound = (F.size(parts) == 5) & (made["language"] != "") & (made["edition"] != "") & (made["kind"] != "") & (made["number"] != "") & made["title"].isNotNull()
    return F.when(F.coalesce(sound, F.lit(False)), out)


def merged_field(old: Column, incoming: Column, rank: Column) -> Column:
    """A field (value, protected, validated, rank) after an incoming value: protected ones stay, validated ones give way
    to a source of a better rank, others to any value that isn't blank."""
    value = F.trim(incoming)
    takes = F.coalesce(value != "", F.lit(False)) & ~F.coalesce(old["protected"], F.lit(False)) & (~F.coalesce(old["validated"], F.lit(False)) | (rank < F.coalesce(old["rank"], F.lit(2**31 - 1))))
    new = F.struct(value.alias("value"), F.lit(False).alias("protected"), F.lit(True).alias("validated"), rank.cast("int").alias("rank"))
    return F.when(takes, new).otherwise(old)
