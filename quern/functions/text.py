"""Text expressions, Column to Column: all native, so they stay in the JVM's generated code."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters as Unicode has them; Java's own classes are ASCII.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
#: The capitals whose lower case differs in Turkish, and the lower case letters without ASCII form.
CAPITALS, SMALL = "IİŞĞÜÖÇ", "ıişğüöç"
LETTERS, ASCII_LETTERS = "ışğüöç", "isguoc"
#: Masks of personal data.
EMAIL_MASK, URL_MASK, PHONE_MASK, ID_MASK, NUMBER_MASK = "[EPOSTA]", "[BAGLANTI]", "[TELEFON]", "[KIMLIK]", "[NUMARA]"
#: Patterns of personal data, applied in this order.
DIGIT = r"\p{Nd}"
PERSONAL = (
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", EMAIL_MASK),
    (r"(?i)\b(?:https?://|www\.)[^\p{IsWhite_Space}\x1c-\x1f]+", URL_MASK),
    (rf"(?<!{DIGIT})(?:\+90[\p{{IsWhite_Space}}.\-]?|0)?[\p{{IsWhite_Space}}.\-]?\(?5{DIGIT}{{2}}\)?[\p{{IsWhite_Space}}.\-]?{DIGIT}{{3}}[\p{{IsWhite_Space}}.\-]?{DIGIT}{{2}}[\p{{IsWhite_Space}}.\-]?{DIGIT}{{2}}(?!{DIGIT})", PHONE_MASK),
    (rf"(?<!{DIGIT})[1-9]{DIGIT}{{10}}(?!{DIGIT})", ID_MASK),
    (rf"(?<!{DIGIT}){DIGIT}{{7,12}}(?!{DIGIT})", NUMBER_MASK),
)
#: Rows that a system wrote.
SYSTEM = (
    rf"(?iu)^{SPACE}*\[?(sistem|system|bot|otomatik)(?!{WORD})",
    rf"(?iu)^{SPACE}*(görüşme|gorusme|oturum|session){SPACE}+(başladı|basladi|bitti|sonlandı)",
    rf"(?iu)^{SPACE}*(null|n/?a|-{{2,}}|\.{{2,}}){SPACE}*$",
)
#: Messages that are courtesy alone, normalized.
COURTESY = ("merhaba", "selam", "teşekkürler", "tesekkurler", "teşekkür ederim", "sağolun", "sagolun", "tamam", "ok", "okey", "peki", "iyi günler", "iyi gunler", "günaydın", "gunaydin", "eyvallah")
#: Words that a signature leaves out.
STOPWORDS = tuple(
    "acaba ama ancak bana bazı belki ben beni benim bir biraz birşey biz bu bunu bunun çok çünkü da daha de defa değil diye diğer eğer en gibi hem hep hepsi her hiç için ile ise kez ki kim mi mı mu mü nasıl ne neden nerde nerede nereden niye o olarak olduğu olur olsun onu şey siz sonra şu tüm ve veya ya yani zaten mısınız misiniz musunuz lütfen merhaba selam teşekkür ederim rica acil bilgi alabilir miyim var yok mıyım edeyim mısın misin bi".split()
)
#: Patterns of secrets in free text, and what stands for one.
SECRETS = (r"(?i)\b(x-openrouter-key|authorization)\b\s*[:=]\s*\S+", r"(?i)\bbearer\s+[A-Za-z0-9._\-]+", r"\bsk-[A-Za-z0-9._\-]{8,}")
REDACTED = "[REDACTED]"
UNTITLED = "Boş mesaj"


def strip(c: Column) -> Column:
    """Without white space, of any kind, at either end."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(c, CAPITALS, SMALL))


def normalize(c: Column) -> Column:
    """The key form of a text: Turkish lower case, words alone, single spaces."""
    return collapse(F.regexp_replace(turkish_lower(c), rf"[^\p{{L}}\p{{N}}_\p{{IsWhite_Space}}\x1c-\x1f]", " "))


def redact(c: Column) -> Column:
    """Personal data as masks: whole addresses first, so that digits within them are not taken apart."""
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), PERSONAL, c)


def truncate(c: Column, most: int) -> Column:
    """At most `most` characters, the last an ellipsis if any are cut."""
    if most <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(rstrip(F.substring(c, 1, most - 1)), F.lit("…")))


def sanitize_sample(c: Column, most: int = 80) -> Column:
    return truncate(redact(collapse(c)), most)


def record_id(normalized: Column) -> Column:
    return F.substring(F.sha2(normalized, 256), 1, 16)


def contextual_id(normalized: Column, context: Column) -> Column:
    """Id of a message with the turns before it; the session has no part in it."""
    turns = F.transform(context, lambda t: F.concat(t["role"], F.lit("\0"), normalize(t["text"])))
    return record_id(F.concat_ws("\x1f", F.concat(F.lit("target\0"), normalized), turns))


def is_system(c: Column) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in SYSTEM))


def is_courtesy(c: Column) -> Column:
    return normalize(c).isin(*COURTESY)


def is_only_masks(normalized: Column) -> Column:
    masks = F.array(*[F.lit(m) for m in sorted(m.strip("[]").lower().replace("i", "ı") for m in (EMAIL_MASK, URL_MASK, PHONE_MASK, ID_MASK, NUMBER_MASK))])
    return (normalized != "") & (F.size(F.array_except(F.split(normalized, " "), masks)) == 0)


def tokens(normalized: Column) -> Column:
    """Words of three letters or more that aren't stop words, in text order."""
    return F.filter(F.regexp_extract_all(normalized, F.lit(f"({WORD}+)"), 1), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS))


def signature(normalized: Column, most: int = 3) -> Column:
    """The first distinct tokens, cut before they are sorted: the leading words carry the topic."""
    return F.array_sort(F.slice(F.array_distinct(tokens(normalized)), 1, most))


def heading(c: Column) -> Column:
    cut = truncate(strip(c), 120)
    return F.when(strip(c) == "", F.lit(UNTITLED)).otherwise(F.concat(F.upper(F.left(cut, F.lit(1))), F.substr(cut, F.lit(2))))


def capitalize(c: Column) -> Column:
    first = F.left(c, F.lit(1))
    return F.concat(F.when(first == "ß", "Ss").otherwise(F.upper(first)), F.lower(F.substr(c, F.lit(2))))


def trim_title(c: Column, most: int = 120) -> Column:
    return truncate(collapse(c), most)


def without_angles(c: Column) -> Column:
    return F.regexp_replace(c, "[<>]", " ")


def slug(c: Column) -> Column:
    """Theme id of a name: Turkish letters to ASCII, other marks dropped, runs of the rest as dashes.

    Decomposition has no native form. Characters that decompose to ASCII letters, by the Unicode
    tables, are replaced, each kind that a text has at once; what is not ASCII then is dropped. No
    pattern names them: a class of so many characters is tried one by one at every place of a text.
    """
    spelled = _decomposed() | dict(zip(LETTERS, ASCII_LETTERS))
    # Of the capitals that Turkish lowers otherwise only the dotted one ends elsewhere: the others have the ASCII letter of their small form.
    lowered = F.lower(F.replace(c, F.lit("İ"), F.lit("i")))
    table = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair])
    found = F.array_intersect(F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x7F])"), 1), F.array(*[F.lit(x) for x in spelled]))
    plain = F.aggregate(found, lowered, lambda text, x: F.replace(text, x, F.element_at(table, x)))
    plain = F.regexp_replace(plain, r"[^\x00-\x7F]", "")
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    # Read in one place, as all of it would be computed again in another.
    return F.concat(F.lit("t-"), F.regexp_replace(dashed, r"\A\z", "diger"))


@cache
def _decomposed() -> dict[str, str]:
    """Characters of the basic plane whose compatibility decomposition has ASCII in it, and that part of it."""
    import unicodedata

    found = {}
    for i in [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]:
        if ascii_part := "".join(x for x in unicodedata.normalize("NFKD", chr(i)) if x < "\x80"):
            found[chr(i)] = ascii_part
    return found


def formula_guard(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula, prefixed by an apostrophe."""
    return F.when(c.rlike(r"^[ \t\r\n]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def mask_secrets(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, REDACTED.replace("$", r"\$")), SECRETS, c)


def render_record(record: Column, text: Column, context: Column | None = None) -> Column:
    """A record as the prompt shows it, angle brackets of its texts replaced."""
    if context is None:
        return F.concat(F.lit('<kayit id="'), record, F.lit('">'), without_angles(text), F.lit("</kayit>"))
    turns = F.array_join(F.transform(context, lambda t: F.concat(F.lit('<mesaj rol="'), t["role"], F.lit('">'), without_angles(t["text"]), F.lit("</mesaj>"))), "")
    return F.concat(F.lit('<kayit id="'), record, F.lit('"><baglam>'), turns, F.lit("</baglam><hedef>"), without_angles(text), F.lit("</hedef></kayit>"))
