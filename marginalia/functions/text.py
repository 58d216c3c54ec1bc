"""Text, path and date functions as Column expressions: all JVM-side, none a UDF.

Lengths and offsets count code points. Ties everywhere end with the key in binary order. Text is expected in NFC; the
sources put it there (functions.udfs.nfc)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of asking that carry no weight, English and Arabic.
STOP_EN = (
    "a an and are as at be but by did do does for from had has have how i in is it its me my of on or our "
    "re so that the their them then there these they this to us was we what when where which who why will with you your "
    "used use uses using talk talked about last week month year say said know need want get got "
    "tell find show give remind remember recall note notes info details detail anything something "
    "mention mentioned ever thing stuff look check search bring pull whats again please kindly"
).split()
STOP_AR = (
    "في من على إلى الى عن أن ان هذا هذه ذلك التي الذي كان كانت هل ما ماذا لما لماذا متى أين اين وين كيف "
    "مع بعد قبل عند لقد قد كل بين تم يتم او أو ثم حتى اذا إذا لكن لا نعم شو ايش وش هو هي انا أنا انت أنت "
    "تتذكر تذكر ذكرني اعطني أعطني ورجع رجعلي ورجعلي ابغى أبغى ابي بدي عايز عاوز قولي وريني بخصوص الوضع قلنا قلت "
    "امس أمس اليوم البارح البارحة سوينا وقفنا صار يصير شي حاجة موضوع وضع خبر جديد اخر آخر اخير أخير مؤخرا مؤخراً ملف اراجع أراجع قارن الفرق كامل لحد هالاسبوع هالشهر"
).split()
# Month names, short and long, and those in Arabic.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec january february march april june july august september october november december".split()
MONTHS_AR = "يناير فبراير مارس أبريل ابريل مايو يونيو يوليو أغسطس اغسطس سبتمبر أكتوبر اكتوبر نوفمبر ديسمبر".split()
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")

STOP = sorted({*STOP_EN, *STOP_AR})
ALL_MONTHS = [*MONTHS, *MONTHS_AR]


def fold_digits(c: Column) -> Column:
    """Arabic-Indic and extended digits as ASCII."""
    return F.translate(c, *DIGITS)


def plain_tokens(c: Column) -> Column:
    """The runs of letters, numbers and marks of a text in lower case, ordinals without their ending; no word is dropped.

    Comments, tatweel and vowel signs are left out, Arabic punctuation parts words. Null gives null."""
    t = fold_digits(F.lower(F.regexp_replace(c, r"<!--[\s\S]*?-->", " ")))
    t = F.regexp_replace(t, "[ـً-ٰٟۖ-ۭ]", "")
    t = F.regexp_replace(t, "[؟؛،۔٪٬]", " ")
    words = F.filter(F.split(t, r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.rlike(r"^[0-9]+(st|nd|rd|th)$"), F.regexp_extract(w, "^([0-9]+)", 1)).otherwise(w))


def tokens(c: Column) -> Column:
    """The index tokens of a text in order: words that are not stop words and longer than a letter, single digits, and after
    a word that a number of up to three digits follows, both as one token ("phase 2")."""
    raw = plain_tokens(c)
    none = F.array().cast("array<string>")

    def of(w: Column, follows: Column) -> Column:
        numbered = F.coalesce(follows.rlike("^[0-9]{1,3}$"), F.lit(False)) & w.rlike(r"^\p{L}+$")
        both = F.concat(w, F.lit(" "), follows)
        return F.when(w.isin(STOP), none).when(numbered, F.when(F.length(w) > 1, F.array(w, both)).otherwise(F.array(both))).when((F.length(w) > 1) | w.rlike("^[0-9]$"), F.array(w)).otherwise(none)

    # the array beside itself moved by one: an index into it within the lambda would make it anew for every word
    return F.flatten(F.zip_with(raw, F.slice(raw, 2, 1_000_000_000), of))


def is_dateish(w: Column) -> Column:
    """Numbers of up to four digits, months, and a word with a number: they locate a note and verify nothing."""
    return w.rlike("^[0-9]{1,4}$") | w.isin(ALL_MONTHS) | w.rlike(r"^\p{L}+ [0-9]{1,3}$")


def typo_budget(length: Column) -> Column:
    return F.when(length < 5, 0).when(length < 9, 1).otherwise(2)


def trigrams(w: Column) -> Column:
    """The distinct 3-grams of a word padded with two spaces before and one after."""
    p = F.concat(F.lit("  "), w, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: p.substr(i, F.lit(3))))


def deletes1(w: Column) -> Column:
    """A word and all its forms with one letter less, not deduplicated."""
    n = F.length(w)
    less = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(w), less)


def skeleton(w: Column) -> Column:
    """The first letter and the rest without vowels, doubled letters once."""
    rest = F.regexp_replace(w.substr(F.lit(2), F.length(w)), "[aeiou]", "")
    return F.regexp_replace(F.concat(w.substr(1, 1), rest), r"(.)\1+", "$1")


def content_hash(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 16)


def basename(path: Column) -> Column:
    """A path's last part without .md."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def top_folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def date_key(path: Column) -> Column:
    """The basename in lower case without numbers of one, two or four digits and months: equal for dated siblings."""
    parts = F.split(F.lower(basename(path)), r"[\s._-]+")
    return F.trim(F.array_join(F.filter(parts, lambda t: (t != "") & ~t.rlike("^([0-9]{1,2}|[0-9]{4})$") & ~t.isin(ALL_MONTHS)), " "))


def _base_words(path: Column) -> Column:
    return F.split(F.lower(basename(path)), r"[^a-z0-9؀-ۿ]+")


def source_prior(path: Column) -> Column:
    """How far a note's place speaks against it: catalogues, logs, verbatim imports and audits; the first rule that fits."""
    base = F.lower(basename(path))
    low = F.lower(path)
    # The places and what they count.
    return (
        F.when(F.arrays_overlap(_base_words(path), F.array(F.lit("index"), F.lit("moc"))), 0.5)
        .when(low.rlike("^(logs|inbox)/"), 0.7)
        .when(low.rlike(r"/raw/|raw exports/|transcripts?/|recovered sessions?/"), 0.55)
        .when(base.rlike(r"\.(docx|pdf|xlsx|pptx)( \([0-9]+\))?$"), 0.55)
        .when(base.rlike(r"(^|[^a-z0-9_])(docs? raw|raw docs?)([^a-z0-9_]|$)|(^|[^a-z0-9_])raw$"), 0.55)
        .when(base.rlike("audit|health check"), 0.6)
        .otherwise(1.0)
    )


def is_catalogue(path: Column) -> Column:
    return (F.lower(basename(path)) == "home") | F.arrays_overlap(_base_words(path), F.array(F.lit("index"), F.lit("moc"), F.lit("map")))


def is_archived(path: Column) -> Column:
    return F.lower(path).rlike("(^|/)archive/")


def is_date_segment(segment: Column) -> Column:
    """A folder that is a year, a month or a number."""
    low = F.lower(segment)
    months = "|".join(MONTHS)
    return low.rlike(r"^[0-9]+$") | low.rlike(rf"^([0-9]{{1,2}}[ _-]*)?({months})$")


def cap_section(c: Column, most: int = 4000) -> Column:
    """A text of at most `most` characters; a longer one ends in a mark."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n…"))).otherwise(c)


def make_date(y: Column, m: Column, d: Column) -> Column:
    """A real calendar date, else null; nothing rolls over."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd")


def month_number(name: Column) -> Column:
    """1 to 12 for an English month name or its first three letters, else null."""
    low = F.lower(name)
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS[:12]]), F.substring(low, 1, 3))
    return F.when(low.isin(MONTHS), at).cast("int")


_DMY = r"\b([0-9]{1,2})\s+([A-Za-z]+)\s+(20[0-9]{2})\b"
_ISO = r"\b(20[0-9]{2}-[0-9]{2}-[0-9]{2})\b"


def _dmy(s: Column) -> Column:
    part = lambda i: F.regexp_extract(s, r"([0-9]{1,2})\s+([A-Za-z]+)\s+(20[0-9]{2})", i)
    month = month_number(part(2))
    return F.when(month.isNotNull(), make_date(part(3).try_cast("int"), month, part(1).try_cast("int")))


def parse_date(s: Column) -> Column:
    """A date at the start of a text, as 2026-07-05 or 5 July 2026; else null."""
    iso = F.regexp_extract(s, "^(20[0-9]{2}-[0-9]{2}-[0-9]{2})", 1)
    dmy = F.regexp_extract(s, r"^([0-9]{1,2}\s+[A-Za-z]+\s+20[0-9]{2})", 1)
    return F.coalesce(F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")), F.when(dmy != "", _dmy(dmy)))


def name_date(path: Column) -> Column:
    """The first real date in a path's last part: 5 Jul 2026 anywhere before 2026-07-05."""
    base = F.substring_index(path, "/", -1)
    dmy = F.filter(F.transform(F.regexp_extract_all(base, F.lit(_DMY), F.lit(0)), _dmy), lambda d: d.isNotNull())
    iso = F.filter(F.transform(F.regexp_extract_all(base, F.lit(_ISO), F.lit(1)), lambda d: F.try_to_date(d, "yyyy-MM-dd")), lambda d: d.isNotNull())
    return F.coalesce(F.get(dmy, F.lit(0)), F.get(iso, F.lit(0)))


def front_value(front: Column, key: str) -> Column:
    """The value of a top-level key of a YAML text as written, without quotes; null if absent or empty."""
    v = F.regexp_extract(front, rf"(?im)^{key}:[ \t]*[\"']?([^\"'\r\n]+)", 1)
    return F.when(F.trim(v) != "", F.trim(v))


def front_date(front: Column) -> Column:
    return F.coalesce(*[parse_date(front_value(front, k)) for k in ("updated", "date", "created")])


def folder_date(path: Column) -> Column:
    """The first of the month of a folder .../2026/07 Jul/..., else null."""
    y, m = (F.regexp_extract(path, r"/(20[0-9]{2})/([0-9]{2})\s+[A-Za-z]{3}/", i) for i in (1, 2))
    return F.when(y != "", make_date(y.try_cast("int"), m.try_cast("int"), F.lit(1)))


def note_date(path: Column, front: Column) -> Column:
    """struct(date, source) of a note: by its name, then its front matter, then its folder; null fields if none has one."""
    n, f, p = name_date(path), front_date(front), folder_date(path)
    return F.struct(F.coalesce(n, f, p).alias("date"), F.when(n.isNotNull(), "name").when(f.isNotNull(), "front").when(p.isNotNull(), "path").alias("source"))


_FENCED = r"(?s)```.*?(```|$)"


def without_fences(body: Column) -> Column:
    return F.regexp_replace(body, _FENCED, " ")


def without_code(body: Column) -> Column:
    return F.regexp_replace(without_fences(body), r"`[^`\n]{0,4000}`", " ")


def note_title(path: Column, body: Column) -> Column:
    """The first top heading outside fences, at most 90 characters; else the basename."""
    h = F.trim(F.regexp_extract(without_fences(body), r"(?m)^# +([^\r\n]+)", 1))
    return F.when(F.coalesce(h, F.lit("")) != "", F.substring(h, 1, 90)).otherwise(basename(path))


def headings(body: Column) -> Column:
    """The texts of the headings of level 1 to 4 outside fences and the first cells of table rows."""
    plain = without_fences(body)
    heads = F.regexp_extract_all(plain, F.lit(r"(?m)^#{1,4} +([^\r\n]+)"), F.lit(1))
    cells = F.regexp_extract_all(plain, F.lit(r"(?m)^\|[ \t]*([^|\r\n]+?)[ \t]*\|"), F.lit(1))
    return F.concat(heads, F.filter(cells, lambda c: ~c.rlike("^[:\\- ]+$")))


def front_matter(raw: Column) -> Column:
    """The YAML text between the first lines --- of a file; null without a closed block."""
    v = F.regexp_extract(raw, r"(?s)^﻿?---\r?\n(.*?)\r?\n---", 1)
    return F.when(raw.rlike(r"(?s)^﻿?---\r?\n.*?\r?\n---"), v)


def file_body(raw: Column) -> Column:
    """What follows the front matter of a file; all of it without a closed block."""
    return F.regexp_replace(raw, r"(?s)^﻿?---\r?\n.*?\r?\n---[ \t]*(\r?\n)?", "")


def raw_text(front: Column, body: Column) -> Column:
    """A file's text from its front matter and body."""
    return F.concat(F.when(front.isNull(), F.lit("")).otherwise(F.concat(F.lit("---\n"), front, F.lit("\n---\n"))), F.coalesce(body, F.lit("")))


def wikilinks(body: Column) -> Column:
    """The targets of [[links]] outside code, embeds left out, as written and trimmed."""
    found = F.regexp_extract_all(without_code(body), F.lit(r"(?<!!)\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != "")


def aliases(front: Column) -> Column:
    """The names under aliases: of a YAML text, as a flow list or a block list; an empty array if there are none."""
    flow = F.regexp_extract(front, r"(?ims)^aliases:[ \t]*\[(.*?)\]", 1)
    block = F.regexp_extract(front, r"(?im)^aliases:[ \t]*\r?\n((?:[ \t]*-[ \t]+[^\r\n]*(?:\r?\n|$))+)", 1)
    of_flow = F.regexp_extract_all(flow, F.lit(r"\s*(\"[^\"]*\"|'[^']*'|[^,\"'][^,]*)\s*(?:,|$)"), F.lit(1))
    of_block = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]+([^\r\n]*)"), F.lit(1))
    items = F.when(flow != "", of_flow).otherwise(of_block)
    bare = F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^([\"'])(.*)\\1$", "$2"))
    return F.coalesce(F.filter(bare, lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def sanitize_segment(c: Column) -> Column:
    """A text as a file name: control signs out, unsafe signs as " - ", no dots or spaces at the ends."""
    t = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), r'\s*[\\/:*?"<>|]+\s*', " - ")
    return F.regexp_replace(F.regexp_replace(t, r"^[. ]+|[. ]+$", ""), r"\s+", " ")


def normalize_rel(c: Column) -> Column:
    """A path with forward slashes and without . and doubled slashes; null if it is absolute, has a drive or climbs out."""
    p = F.regexp_replace(c, r"\\", "/")
    parts = F.filter(F.split(p, "/+"), lambda s: (s != "") & (s != "."))
    # ".." takes back the part before it; one that has none to take back marks an escape
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(1)) == ".."), F.concat(F.array(F.lit("..")), acc)).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))))
    return F.when(p.rlike("^(/|[A-Za-z]:)") | (F.get(walked, F.lit(0)) == ".."), F.lit(None)).otherwise(F.array_join(walked, "/"))


def defang(c: Column) -> Column:
    """A text in which no forged attribution comment stands."""
    return F.regexp_replace(c, r"(?is)<!--\s*(✍|written by)", "<!- $1")


def relative_time(ms: Column, now_ms: Column) -> Column:
    """Just now, minutes, hours or days before now: up to 90 s, 90 min and 36 h."""
    s = (now_ms - ms) / 1000.0
    return F.when(s < 90, "just now").when(s < 5400, F.concat(F.round(s / 60).cast("int").cast("string"), F.lit(" min ago"))).when(s < 129_600, F.concat(F.round(s / 3600).cast("int").cast("string"), F.lit(" h ago"))).otherwise(F.concat(F.round(s / 86_400).cast("int").cast("string"), F.lit(" d ago")))


def money(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"\$ ?[0-9,]{3,}"), F.lit(0)))


def is_episodic(q: Column) -> Column:
    # Fixed value: phrases that ask for a past talk.
    return F.lower(q).rlike("(discussed?|conversation|memor(y|ies)|remember|talked|chat(ted)?|we (said|spoke)|did we)")


def is_status(q: Column) -> Column:
    return F.array_join(tokens(q), " ").rlike(r"\b(status|stopp?e?d?|left|resume|continue|latest|last|standing|progress|update)\b")


# Fixed value: phrases that ask for what is recent.
TEMPORAL = (
    r"(?i)(yesterday|today|tonight|this (week|month|morning)|last (week|month|night|meeting|session|time)|recently|latest|newest|most recent|(?:what'?s|anything|something|whats) new"
    r"|just (?:built|shipped|committed|made|added|finished|did|created|wrote|pushed)|not long ago|a while (?:back|ago)|lately|of late|these days|(?:in )?recent days"
    r"|where (?:did |do )?(?:i|we) (?:leave off|left off|stop|stopped)|where (?:do|does)(?: things| it| we)? stand|stands? (?:now|today|currently|right now)|where are we (?:on|with|at)"
    r"|what happened lately|what'?s fresh|anything fresh|catch me up|bring me up to speed|till now|so far|right now|at the moment|last (?:\d+|two|three|four|few|couple(?: of)?) (?:days?|weeks?|months?)"
    "|امس|أمس|اليوم|البارح|هالاسبوع|هالشهر|هالايام|هاليومين|من فترة|من مدة|اخر|آخر|مؤخرا|مؤخراً|وين وقفنا|وين وصلنا|لحد الان|لحد الآن)"
)
# Phrases of asking, which say nothing of what is asked for.
FRAMES = (
    r"\bi (?:need|want|would like|'?d like) to (?:review|see|check|read|look at|revisit|go over)\b", r"\bwhat(?:'?s| was| is)? (?:the )?deal with\b", r"\bcan you (?:pull up|bring up|show me|get me|find me|grab|open)\b",
    r"\b(?:pull|bring) up\b", r"\bshow me\b", r"\bfor me\b", r"\bwhere did we (?:leave|stop with|leave off (?:on|with)?)\b", r"\bwhat did we do (?:recently|yesterday|today|last (?:week|month|time)) (?:with|on|in|about)\b",
    r"\b(?:what'?s\s+)?(?:the\s+)?latest (?:on|about|with)\b", r"\bwhat(?:'?s| is) (?:the )?(?:status|update) (?:on|of|with)\b", r"\bwhat(?:'?s| is) going on with\b", r"\bwhat happened(?: (?:with|to|in|on|at|around))?\b",
    r"\bwhat'?s the story (?:with|on|behind)\b", r"\bdid we (?:ever )?(?:discuss|talk about|cover|go over)\b", r"\bcatch me up (?:on|with)\b", r"\bwhat(?:'?s| is| are)?\s+new\s+(?:with|on|for|about|in|regarding)\b", r"\bmost recent\b",
    r"\bwhere (?:do|does)\s+(?:things|it|stuff|matters?|we)\s+stand\b", r"\bwhere (?:are|were)\s+we\s+(?:on|with|at|regarding|in)\b", r"\bwhat happened\s+lately\s+(?:with|to|on|in|about)\b", r"\bstands?\s+(?:now|today|currently|right now|at the moment)\b",
    r"\bwhere (?:do|does|is|are)\b(?=.{0,60}\bstands?\b)", r"\bhow(?:'?s| is| are)?\s+(?:it|things)\s+going\s+(?:with|on|for)\b", r"\bremind me (?:about|of)\b", r"\bany notes? (?:on|about|for|regarding)\b",
    r"\bnotes? (?:mentioning|that mention|discussing|containing|about)\b", r"\banything (?:on|about|regarding|for|mentioning)\b", r"\bwhere do (?:we|i) talk about\b", r"\bdo (?:we|i) have anything (?:on|about)\b",
    r"\b(?:in|into|to|from|inside) (?:the |my )?(?:second )?brain\b(?=\s*(?:[?.!,;]|$))", r"\bwhat (?:was|is|were) included in\b", r"\b(?:the )?latest updates? (?:on|to|of|for|about)\b", r"\b(?:pull up |bring up )?my notes? (?:on|about|for|regarding)\b",
    r"\bfind me (?:the )?\b", r"\bwhere(?:'?s| is| are)? (?:the |my )\b", r"\b(?:do you |can you )?remember (?:the |that |our )?\b", r"\bwhat do (?:we|i|you) know about\b", r"\bstuff\s*\??\s*$", r"\bagain\s*\??\s*$",
    r"\bwhat date (?:was|is|did)\b", r"\bwhen (?:was|is|did) (?:we|i|you|the)?\b", r"\bhow much (?:was|is|for|did)\b", r"\bwhat(?:'?s| is)? the figure for\b", r"\bwhat number did (?:we|i|you) land on for\b",
    r"\bwhat(?:'?s| is)? the\b(?=.{0,50}\bamount\b)", r"\bamount\s*\??\s*$", "وش سالفة", "في شي (?:مسجل|مكتوب|محفوظ) عن",
)
# Phrases that ask to build something, and what they put around its subject.
BUILD = (
    r"(?i)(?:build|creat\w*|implement\w*|develop\w*|draft|prepar\w*|design\w*|writ\w*|mak\w*|set\s*up)\s+(?:(?:me|us)\s+(?:an?\s+|the\s+)?|(?:an?|the)\s+)(?:new\s+)?[^.?!]{0,40}?"
    r"(?:\b(?:poc|proof of concept|prototype|proposal|demo|pitch|deck|integration|solution|architecture|plan|workflow|agent|app|api))|based on (?:what|everything|all)|using (?:what|everything|all)\s+(?:we|you|i)\s+know"
)
BUILD_FRAMES = (
    r"\b(?:build|make|create|draft|prepare|design|write)\s+(?:(?:me|us)\s+(?:an?\s+|the\s+)?|(?:an?|the)\s+)(?:new\s+)?(?:poc|proof of concept|prototype|demo|proposal|pitch(?:\s+deck)?|deck|integration plan|plan|workflow|app|api|agent|solution|architecture)\b",
    r"\bfor\s+(?:an?\s+)?(?:new\s+)?(?:client|customer|company|prospect)\b", r"\b(?:based on|using)\s+(?:what|everything|all)\s+(?:we|you|i)\s+know(?:\s+about)?",
)


def is_temporal(q: Column) -> Column:
    return q.rlike(TEMPORAL)


def is_build(q: Column) -> Column:
    """Whether a question asks to make something of what is known."""
    return q.rlike(BUILD)


def strip_frames(q: Column) -> Column:
    """A question without the phrases of asking; as it was if no word is left."""
    plain = lambda c, frames: reduce(lambda a, f: F.regexp_replace(a, "(?i)" + f, " "), frames, c)
    bare = plain(q, FRAMES)
    left = F.trim(F.regexp_replace(F.when(is_build(q), plain(bare, BUILD_FRAMES)).otherwise(bare), r"\s+", " "))
    return F.when(F.size(tokens(left)) == 0, q).otherwise(left)


def relationship_role(q: Column) -> Column:
    """The role of a question like "who is our accountant", as written; null for other questions."""
    role = F.regexp_extract(F.lower(q), r"\bwho(?:'?s| is| are|'re)\s+(?:my|our)\s+([a-z][a-z '-]*)", 1)
    return F.when(role != "", F.trim(role))


def boundary_hits(text: Column, phrase: Column) -> Column:
    """How often a phrase stands in a text with no letter, number, -, _, / or \\ beside it; case counts for nothing."""
    quoted = F.concat(F.lit(r"\Q"), F.lower(phrase), F.lit(r"\E"))
    return F.size(F.regexp_extract_all(F.lower(text), F.concat(F.lit(r"(?<![\p{L}\p{N}\-_/\\])"), quoted, F.lit(r"(?![\p{L}\p{N}\-_/\\])")), F.lit(0)))


def rewrite_token(q: Column, old: Column, new: Column) -> Column:
    """A question with a token replaced where it stands alone."""
    return F.regexp_replace(q, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}\p{M}])\Q"), old, F.lit(r"\E(?![\p{L}\p{N}\p{M}])")), new)
