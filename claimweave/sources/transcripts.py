"""Call transcripts to speaker turns, by windows over lines (gaps and islands); no Python on the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.numbers import let

# Forms of speaker lines and section headers.
NAME = r"[A-Z][A-Za-z.'\-]+(?:\s+[A-Z][A-Za-z.'\-]+){0,3}"
TITLED = rf"^({NAME})\s*[-–—]{{1,2}}\s+(.+)$"
SPOKEN = rf"^(Operator|Analyst|{NAME})\s*:\s*(.*)$"
OPERATOR = r"(?i)^(operator)\s*$"
SHOUTED = r"^([A-Z][A-Z .'()\-]{1,40})\s*:\s*(.*)$"
BARE_WORD = r"(?:[A-Z][a-z][A-Za-z.'\-]*|[A-Z]\.)"
BARE = rf"^(?:Operator|{BARE_WORD}(?:\s+{BARE_WORD}){{0,4}})$"
DASH = r"\s*[-–—]{1,2}\s*"
PREAMBLE = r"(?i)^(date|call\s+participants|industry\s+glossary)\s*:?\s*$"
CALL_START = r"(?i)^(full\s+conference\s+call\s+transcript|conference\s+call\s+transcript|prepared\s+remarks|questions?\s*(?:&|and)\s*answers?)\s*:?\s*$"
DIALOGUE = r"(?i)^(thank|thanks|good|hi|hello|yes|no|sure|well|okay|ok|great|all right|alright|let me|i |we |our |as |today|afternoon|morning|evening|and |on the|welcome|ladies)\b"
GLOSSARY = r"^(The|A|An|Direct|Existing|Total|Risk|Meta|Apple|Alphabet|Proposed|Application|Original|High|Revenue|Tensor)\b"
NOT_NAMES = "company representatives|participants|conference call participants|duration|contents|date|call participants|industry glossary".split("|")
NOT_BARE = "yeah yes yep no sure well okay ok look great thanks thank right alright hello hi good and so now next first".split()
TITLE_WORDS = r"(?i)\b(chief|officer|president|chairman|chair|director|svp|evp|vp|ceo|cfo|coo|cto|cmo|general\s+counsel|secretary|manager|analyst|founder|co-founder)\b"
PRODUCTS = (
    "optimus cybercab powerwall bedrock copilot agent fabric gemini epyc instinct rackscale rocm xpu dsp vcf scb nvfi arpu threads "
    "upgraders installed metaverified metai"
).split()
NAME_PART = r"^[A-Z](?:[a-zA-Z.'\-]*[A-Za-z.]|[.])$"
INITIALS = r"^(?:[A-Z]\.){1,3}[A-Z]?\.?$"
PARTICIPANTS_HEAD = r"(?i)^call\s+participants:?$"
SECTION_HEADS = (
    r"(?i)^(?:(?:date|call\s+participants|industry\s+glossary|takeaways?|summary|risks?|contents?|prepared\s+remarks?|questions?\s*(?:&|and)\s*answers?):?\s*"
    r"|(?:full\s+conference\s+call\s+transcript|conference\s+call\s+transcript|transcript\s+of\s+the\s+(?:earnings\s+)?call)\s*:?\s*)$"
)
MIN_CHARS, MIN_SPEAKERS = 1500, 2
HEAD_CHARS, LONG_LINE, TITLE_LIMIT, ACRONYM, SHORT_NAME = 80, 160, 14, 5, 4


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _words(value: Column) -> Column:
    return F.filter(F.split(value, r"\s+"), lambda w: w != "")


def title_case(value: Column) -> Column:
    """Every run of letters with its first letter large, the others small."""
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(r"(?U)(\p{L}+|\P{L}+)"), 1), F.initcap), "")


def normalized_name(name: Column) -> Column:
    """White space collapsed, dashes and stops at the ends gone, capitals-only names in title case."""
    def cased(plain: Column) -> Column:
        return F.when((plain == F.upper(plain)) & plain.rlike("[A-Z]") & (F.length(plain) > 3), title_case(plain)).otherwise(plain)

    return let(F.btrim(F.regexp_replace(name, r"\s+", " "), F.lit(" -:.")), cased)


def is_person(name: Column) -> Column:
    """Whether a name may be a speaker's: one to four words of a name's form, no title, product or acronym."""
    def plausible(x: Column) -> Column:
        bare = F.regexp_replace(x, "[^A-Za-z]", "")
        acronym = (bare == F.upper(bare)) & F.length(bare).between(1, ACRONYM)
        return x.rlike(NAME_PART) & ~x.rlike("-[a-z]") & (~acronym | x.rlike(INITIALS))

    parts = _words(name)
    short = (F.size(parts) == 1) & (F.length(F.regexp_replace(name, "[^A-Za-z]", "")) <= SHORT_NAME)
    person = F.size(parts).between(1, 4) & ~name.rlike(TITLE_WORDS) & ~F.lower(F.replace(name, F.lit(" "), F.lit(""))).isin(PRODUCTS) & F.forall(parts, plausible) & ~short
    return F.lower(name).isin("operator", "analyst") | person


def participant(line: Column) -> Column:
    """Struct (name, title) of ``Name -- Title`` or ``Title — Name``; null where the line is neither."""
    def judged(x: Column) -> Column:
        left, right = x["left"], x["right"]
        left_title, right_title, n_left, n_right = left.rlike(TITLE_WORDS), right.rlike(TITLE_WORDS), F.size(_words(left)), F.size(_words(right))
        forward, backward = (F.struct(a.alias("name"), b.alias("title")) for a, b in ((left, right), (right, left)))
        found = (
            F.when(left_title & ~right_title & n_right.between(1, 5), backward)
            .when(right_title & ~left_title & n_left.between(1, 5), forward)
            .when(n_left.between(1, 4) & (F.length(right) > F.length(left)), forward)
            .when(n_right.between(1, 4) & left_title, backward)
        )
        return F.when((left != "") & (right != ""), found)

    parts = F.split(line, DASH, 2)
    return let(F.struct(strip(parts[0]).alias("left"), strip(F.get(parts, 1)).alias("right")), lambda x: F.when(x["right"].isNotNull(), judged(x)))


def speaker_of(line: Column) -> Column:
    """Struct (speaker, rest, title), null where the line opens no turn."""
    none = F.lit(None).cast("string")
    kind = "struct<speaker:string,rest:string,title:string>"

    def made(name: Column, rest: Column, title: Column) -> Column:
        return F.struct(name.alias("speaker"), rest.alias("rest"), title.alias("title")).cast(kind)

    def checked(x: Column) -> Column:
        """A name with what follows it, if it is a person's and no glossary entry."""
        glossary = x["rest"].rlike(GLOSSARY) & ~x["rest"].rlike(DIALOGUE)
        long_title = F.coalesce(F.size(_words(x["title"])) > TITLE_LIMIT, F.lit(False))
        return F.when(~F.lower(x["speaker"]).isin(NOT_NAMES) & is_person(x["speaker"]) & ~long_title & ~glossary, x)

    def opened(text: Column) -> Column:
        head = F.substring(text, 1, HEAD_CHARS)
        inline = head.contains(":") | head.contains(" -- ") | head.contains(" — ")

        def dashed(p: Column) -> Column:
            left = strip(F.split(text, DASH, 2)[0])
            before = F.substring(F.substring_index(F.substring_index(text, "—", 1), "–", 1), 1, 40)
            return p.isNotNull() & ~before.contains(":") & (F.lower(left) == F.lower(p["name"])) & is_person(p["name"])

        def by_form(p: Column) -> Column:
            found = F.when(dashed(p), F.when(F.size(_words(p["title"])) <= TITLE_LIMIT, made(normalized_name(p["name"]), F.lit(""), p["title"])))
            forms = ((TITLED, False), (SPOKEN, True), (OPERATOR, None), (SHOUTED, True))
            for pattern, spoken in forms:
                rest = strip(F.regexp_extract(text, pattern, 2)) if spoken else F.lit("")
                title = strip(F.regexp_extract(text, pattern, 2)) if spoken is False else none
                found = found.when(text.rlike(pattern), let(made(normalized_name(F.regexp_extract(text, pattern, 1)), rest, title), checked))
            alone = ~inline & ~text.rlike("[.!?,:;]$") & text.rlike(BARE) & ~F.lower(text).isin(NOT_NAMES) & is_person(text)
            alone = alone & ~F.exists(F.split(F.lower(F.regexp_replace(text, r"[^A-Za-z\s]", " ")), r"\s+"), lambda w: w.isin(NOT_BARE))
            return found.when(alone, made(normalized_name(text), F.lit(""), none))

        too_long = ~inline & (F.length(text) > LONG_LINE)
        return F.when((text != "") & ~too_long, let(participant(text), by_form))

    # Most lines are speech: only those that begin like a name are looked at closely.
    return let(strip(line), lambda text: F.when(text.rlike("^[A-Z]|(?i)^operator"), opened(text)))


def _is_header(text: Column) -> Column:
    return text.rlike(PREAMBLE) | text.rlike(CALL_START)


def is_valid(text: Column) -> Column:
    heads = F.size(F.filter(F.split(text, "\n"), lambda x: speaker_of(x).isNotNull() & ~_is_header(strip(x))))
    return (F.length(text) >= MIN_CHARS) & (heads >= MIN_SPEAKERS)


def lines_of(calls: DataFrame, keys: list[str], body: str = "text") -> DataFrame:
    unix = F.replace(F.replace(F.coalesce(F.col(body), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return calls.select(*keys, F.posexplode(F.split(unix, "\n")).alias("pos", "raw")).select(*keys, "pos", strip(F.col("raw")).alias("line"))


def roster(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, role, pos): titles by lower-case name, from the participants' block and from headers in the call.

    In the block the last mention of a name counts, elsewhere the first; the block goes before.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    read = lines.withColumns({"p": participant(F.col("line")), "s": speaker_of(F.col("line"))})
    event = F.when(F.col("line").rlike(PARTICIPANTS_HEAD), True).when(F.col("line").rlike(SECTION_HEADS) | (F.col("s").isNotNull() & F.col("p").isNull()), False)
    block = F.coalesce(F.last(event, ignorenulls=True).over(order), F.lit(False))
    named = read.withColumn("block", block).where("p is not null and (block or s is not null)")
    name = F.trim(F.lower(F.regexp_replace("p.name", r"\s+", " ")))
    return named.groupBy(*keys, name.alias("name")).agg(
        F.coalesce(F.max_by("p.title", F.when(F.col("block"), F.col("pos"))), F.min_by("p.title", "pos")).alias("role"), F.min("pos").alias("pos"),
    )


def turns(calls: DataFrame, keys: list[str], body: str = "text") -> DataFrame:
    """(keys, turn, speaker, role, text): one row for each continuous turn, preamble skipped.

    A line is in the preamble until a call-start header or a strong turn (the operator, a name alone, a
    titled name, or ``Name:`` followed by talk) comes after the last preamble header.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    lines = lines_of(calls, keys, body).withColumn("s", F.when(~_is_header(F.col("line")), speaker_of(F.col("line"))))
    talk = (F.col("s.rest") == "") | (F.lower("s.speaker") == "operator") | F.col("s.rest").rlike(DIALOGUE)
    event = F.when(F.col("line").rlike(PREAMBLE), 0).when(F.col("line").rlike(CALL_START) | (F.col("s").isNotNull() & talk), 1)
    seen = lines.withColumn("inside", F.coalesce(F.last(event, ignorenulls=True).over(order), F.lit(0)) == 1)
    opened = seen.where("inside").where(~F.col("line").rlike(CALL_START)).withColumn("turn", F.count("s").over(order)).where("turn > 0")
    said = F.when(F.col("s").isNotNull(), F.col("s.rest")).otherwise(F.col("line"))
    return (
        opened.groupBy(*keys, "turn")
        .agg(
            F.first("s.speaker", ignorenulls=True).alias("speaker"), F.nullif(F.first("s.title", ignorenulls=True), F.lit("")).alias("role"),
            strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))), lambda x: x["said"]), "\n")).alias("text"),
        )
        .where("text <> ''")
    )


def with_roles(said: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """A turn's own title, else the roster's: by name, by first and last word, then by a last word that only one has.

    A call's roster is as long as its list of speakers, so it travels as one array.
    """
    listed = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "role"))).alias("__roster"))
    words = lambda x: F.split(x, " ")
    mine = F.trim(F.lower(F.regexp_replace("speaker", r"\s+", " ")))

    def looked_up(x: Column) -> Column:
        first, last, many = words(x)[0], F.element_at(words(x), -1), F.size(words(x)) >= 2
        exact = F.filter("__roster", lambda r: r["name"] == x)
        ends = F.filter("__roster", lambda r: many & (F.size(words(r["name"])) >= 2) & (words(r["name"])[0] == first) & (F.element_at(words(r["name"]), -1) == last))
        unique = F.filter("__roster", lambda r: F.element_at(words(r["name"]), -1) == last)
        return F.coalesce(F.get(exact, F.lit(0))["role"], F.get(ends, F.lit(0))["role"], F.when(F.size(unique) == 1, F.get(unique, F.lit(0))["role"]))

    joined = said.join(listed, keys, "left")
    return joined.withColumn("role", F.nullif(F.coalesce("role", let(mine, looked_up)), F.lit(""))).drop("__roster")


def chunk_transcripts(calls: DataFrame) -> DataFrame:
    """``calls(ticker, company_name, fiscal_year, fiscal_quarter, call_date, text)`` -> chunk rows with ids."""
    keys = ["ticker", "fiscal_year", "fiscal_quarter"]
    made = with_roles(turns(calls, keys), roster(lines_of(calls, keys), keys), keys)
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("turn")) - 1
    meta = [c for c in ("company_name", "call_date") if c in calls.columns]
    return made.withColumn("i", index).join(calls.select(*keys, *meta), keys).select(
        ids.chunk_id(F.col("ticker"), F.col("fiscal_year"), F.col("fiscal_quarter"), F.lit("transcript"), F.col("i")).alias("chunk_id"),
        F.upper("ticker").alias("ticker"), *meta, F.lit("transcript").alias("doc_type"), "fiscal_year", F.col("fiscal_quarter").alias("fiscal_period"), F.lit(False).alias("is_table"),
        F.col("speaker").alias("speaker_name"), F.col("role").alias("speaker_role"), "text",
    )
