"""Surrogates for personal data, with DataFrame functions only.

Detection: a pattern for each type (e-mail addresses, bank accounts, phone numbers, social security numbers, hexadecimal secrets, payment cards, IPv6 and IPv4
addresses, names after a title), each tried only on texts that pass a cheap test of its own. Cards must pass the Luhn test and bank accounts the remainder
97 test, else they are left alone. Names found after a title are then looked for in the whole document, so that later mentions without a title
are replaced too. A text is the gaps and matches of its patterns in turn, so replacing the matches leaves the rest as it was.

Replacement: keyed and a function of the value alone, so that one value has one surrogate in the whole corpus, however it is written.
  * Phone and social security numbers: a keyed Feistel network over the valid numbers (areas and exchanges that exist), so that valid ones stay valid. A country code other than 1 stays. An
    invalid number keeps what makes it so (its area, or the first digits of area and exchange).
  * IPv4 addresses: likewise within their kind (10/8, 127/8, 172.16/12, 192.168/16, other). Cards keep their first digits and get a new check digit, bank accounts their country, shape and new check digits.
  * E-mail addresses, secrets, IPv6 addresses: each character by one of its class from a keyed hash; a domain becomes a reserved example domain, the first group of an IPv6 address stays.
  * Names, part by part: given names by one of their script and gender (by title, else by form); surnames by one of their script, whatever the title. Where surnames inflect (Cyrillic -ov, -ev, -in), both forms have
    one stem; Greek ones keep the form of their ending. Particles stay, initials become others.
Two values of one type never share a surrogate and no surrogate is a value that occurs (so none is its own): names of all kinds are one type here. The
distinct values of the corpus are settled in rounds; those whose surrogate is taken try the next attempt, until none is left. Values past their first attempt
go back to the documents that hold them by a join; documents without any take no part in it.

Defined results: a null text stays null, without entities; equal texts get equal texts; a null doc_id is a row like any other; repeated rows get equal rows; very long texts are treated whole; an empty table gives no rows; extra
columns are not read. Two ways of writing one IPv6 address are two values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize

KEY = "palimpsest-key-1"
#: Attempts after which a surrogate may leave the kind of its value (a kind may have fewer values than the corpus has).
PATIENCE = 16

#: Titles by the gender that they tell.
TITLES = {
    "m": "Mr Sir Lord Herr Señor Sr Don Monsieur Signor Signore г-н господин κ κύριος".split(),
    "f": "Mrs Ms Miss Lady Dame Frau Señora Señorita Sra Srta Doña Madame Mme Mlle Signora г-жа госпожа κα κυρία".split(),
    "": "Dr Prof Professor Rev Capt Sgt Judge д-р проф Δρ Պրն Տկն".split(),
}
PARTICLES = "van von der den de del della da di du la le bin ibn al el".split()
#: Common given names whose form tells the other gender (Latin: -a, -e, -i, -y and -h are taken for female, the rest for male; Cyrillic: -а, -я).
MALE = "Luca Joshua Ezra Elisha Noah Elijah Micah George Mike Steve Dave Joe Pete Jake Luke Blake Kyle Eugene Lee Bruce Wayne Dale Duke Pierre Jorge Felipe Enrique Vicente Levi Eli Giovanni Luigi Ali Harry Henry Larry Gary Barry Terry Jerry Perry Anthony Tony Jimmy Billy Bobby Danny Johnny Tommy Jeremy Timothy Gregory Geoffrey Jeffrey Stanley Roy Ray Guy Troy Jay Andy Randy Ricky Freddy Joseph Ralph Keith Kenneth Hugh Никита Илья Лука Фома Кузьма".split()
FEMALE = "Ann Susan Karen Helen Carol Margaret Sharon Megan Jennifer Heather Kim Jean Joan Ellen Kathleen Carmen Isabel Ingrid Astrid Gudrun Lauren Erin Robin Allison Alison Marion Vivian Lillian Gillian Janet Harriet Juliet Bridget Violet Pearl Jill Gail Abigail Rachel Mabel Muriel Doris Iris Phyllis Frances Agnes Ines Mercedes Dolores Любовь Нинель".split()

_TITLE = "(?:" + "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)) + r")\.? "
_NAME = r"(?!" + _TITLE + r")\p{Lu}(?:[\p{Ll}\p{M}]|['’-](?=\p{Lu}\p{Ll})|(?<=[\p{Ll}'’-])\p{Lu}(?=\p{Ll}))+"
_PARTICLE = "(?:(?:" + "|".join(PARTICLES) + ") ){0,3}"
TITLED = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})+{_PARTICLE}{_NAME}(?: \p{{Lu}}\.)?(?: {_PARTICLE}{_NAME})?"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GROUPS = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
#: Type, test that a text must pass, and pattern, in the order in which they are tried at a place.
PATTERNS = [
    ("email", "@", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"),
    ("iban", "[A-Z]{2}[0-9]{2}[ 0-9A-Z]{11}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,4})?)(?![A-Za-z0-9])"),
    ("phone", r"[0-9]{3}[-. )][ -]?[0-9]{3}[-. ][0-9]{4}", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{3}\)[ -]?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"),
    ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("secret", "[0-9A-Fa-f]{32}", r"(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"),
    ("card", "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"),
    ("ipv6", "[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:|::[0-9A-Fa-f]", rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?:{_GROUPS})?::(?:{_GROUPS})?)(?![0-9A-Za-z:])"),
    ("ipv4", "[0-9][.][0-9]{1,3}[.][0-9]", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
]
#: First letters and the rest of a title before a capital: what a text with a titled name holds.
TITLE_TEST = "[" + "".join(sorted({t[0] for ts in TITLES.values() for t in ts})) + "](?:" + "|".join(sorted({t[1:] for ts in TITLES.values() for t in ts}, key=len, reverse=True)) + r")\.? \p{L}"

#: Given names by script and gender, syllables by script, and endings of the surnames made of them by kind.
GIVEN = {
    "given:latin:f": "Alma Berta Clara Dora Elena Flora Greta Hanna Irma Julia Lena Marta Nora Olga Paula Rosa".split(),
    "given:latin:m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Leon Martin Noah Oscar Paul Ralf".split(),
    "given:cyrillic:f": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Раиса Софья Тамара Юлия".split(),
    "given:cyrillic:m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур".split(),
    "given:greek:f": "Άννα Ελένη Ειρήνη Ζωή Θάλεια Ιωάννα Κλειώ Λυδία Μαρία Νίκη Ξένια Όλγα Σοφία Χαρά".split(),
    "given:greek:m": "Άγγελος Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λουκάς Μάρκος Νίκος Παύλος Σπύρος Τάσος Χρήστος".split(),
    "given:armenian:f": "Անահիտ Աննա Արփի Գայանե Եվա Լիլիթ Մարիամ Նարե Շուշան Սոնա".split(),
    "given:armenian:m": "Արամ Արմեն Գագիկ Դավիթ Հայկ Հրանտ Կարեն Նարեկ Սուրեն Տիգրան".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do ga ha ka ke la le lo ma me mo na ne no pa ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо ва ве во га да де до ка ке ла ле ло ма ме мо на не но па ра ре ро са се со та те то".split(),
    "greek": "βα βε βο γα γε γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το".split(),
    "armenian": "բա բե բո գա գե գո դա դե դո կա կե կո լա լե լո մա մե մո նա նե նո սա սե սո տա տե տո".split(),
}
ENDINGS = {"surname:latin": "ner", "surname:cyrillic:inflected": "нов", "surname:cyrillic:plain": "ко", "surname:greek:m": "ίδης", "surname:greek:f": "ίδου", "surname:armenian": "յան"}
_FEMININE = "(?:ов|ев|ёв|ин|ын)а$"


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _number(hexed: Column, at: Column | int = 1, digits: int = 12) -> Column:
    return F.conv(F.substring(hexed, at, digits) if isinstance(at, int) else F.substr(hexed, at, F.lit(digits)), 16, 10).cast("long")


def _feistel(key: str, tweak: Column, left: Column, right: Column, left_size: Column | int, right_size: Column | int) -> Column:
    """A keyed permutation of l < left_size, r < right_size: six rounds, each adds a hash of one half to the other. A struct of l and r."""
    left_size, right_size = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (left_size, right_size))
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc, k):
        to_left = F.pmod(acc["l"] + _number(_hash(key, tweak, k.cast("string"), acc["r"].cast("string"))), left_size)
        to_right = F.pmod(acc["r"] + _number(_hash(key, tweak, k.cast("string"), acc["l"].cast("string"))), right_size)
        return F.when(k % 2 == 0, F.struct(to_left.cast("long").alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), to_right.cast("long").alias("r")))

    return F.aggregate(F.array(*map(F.lit, range(6))), start, step)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _padded(n: Column, digits: Column | int) -> Column:
    return F.lpad(n.cast("long").cast("string"), digits, F.lit("0")) if not isinstance(digits, int) else F.lpad(n.cast("long").cast("string"), digits, "0")


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(12)]), (n + 1).cast("int"))


def permuted_digits(key: str, tweak: Column, digits: Column) -> Column:
    """Another string of as many digits (2 to 20), a different one for each."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    b = n - a
    moved = _feistel(key, F.concat(tweak, n.cast("string")), F.substr(digits, F.lit(1), a), F.substr(digits, a + 1, b), _power(a), _power(b))
    return _let(moved, lambda m: F.concat(_padded(m["l"], a), _padded(m["r"], b)))


def in_format(value: Column, new: Column, kept: str = "[0-9]") -> Column:
    """value with its characters of a class replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda acc, c: F.when(c.rlike(kept), F.struct(F.concat(acc["out"], F.substr(new, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))
    return F.aggregate(F.split(value, ""), start, step)["out"]


def check_digit(body: Column) -> Column:
    """The Luhn digit that completes a string of digits."""
    chars = F.reverse(F.split(body, ""))
    value = F.aggregate(F.transform(chars, lambda c, i: F.when(i % 2 == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))), F.lit(0), lambda s, x: s + x)
    return F.pmod(F.lit(10) - F.pmod(value, F.lit(10)), F.lit(10)).cast("int")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def passes_luhn(v: Column) -> Column:
    return _let(_digits(v), lambda d: check_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1)).cast("int"))


def _remainder_97(text: Column) -> Column:
    """Of the number that letters (A is 10) and digits spell."""
    step = lambda s, c: F.when(c.between("0", "9"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def passes_97(v: Column) -> Column:
    flat = F.replace(v, F.lit(" "))
    return F.length(flat).between(15, 34) & (_remainder_97(F.concat(F.substr(flat, F.lit(5), F.length(flat)), F.substr(flat, F.lit(1), F.lit(4)))) == 1)


# --- surrogates by type: of a value's key and an attempt ---------------------------------------------------------------


def _card(key: str, v: Column, attempt: Column) -> Column:
    n = F.length(v)
    kept = F.when(F.substring(v, 1, 1).isin("2", "3", "6"), 4).otherwise(2)
    head = F.substr(v, F.lit(1), kept)
    body = F.concat(head, permuted_digits(key, F.concat_ws(":", F.lit("card"), head, attempt.cast("string")), F.substr(v, kept + 1, n - 1 - kept)))
    return _let(body, lambda b: F.concat(b, check_digit(b).cast("string")))


def _exists(x: Column) -> Column:
    """Whether a three-digit area or exchange can exist: it begins with 2 to 9 and does not end in 11."""
    return (x >= 200) & (x % 100 != 11)


def _rank(x: Column) -> Column:
    """The place of x among those that can exist, 792 in all."""
    return (F.floor(x / 100) - 2) * 99 + x % 100 - F.when(x % 100 > 11, 1).otherwise(0)


def _of_rank(n: Column) -> Column:
    return (F.floor(n / 99) + 2) * 100 + n % 99 + F.when(n % 99 >= 11, 1).otherwise(0)


def _phone(key: str, v: Column, attempt: Column) -> Column:
    """v: country code (none for 1), a colon, ten digits."""
    code, ten = F.split_part(v, F.lit(":"), F.lit(1)), F.split_part(v, F.lit(":"), F.lit(2))
    tweak = F.concat_ws(":", F.lit("phone"), code, attempt.cast("string"))
    area, exchange, line = F.substring(ten, 1, 3).cast("int"), F.substring(ten, 4, 3).cast("int"), F.substring(ten, 7, 4).cast("int")
    valid = _feistel(key, tweak, _rank(area), _rank(exchange) * 10000 + line, 792, 7_920_000)
    valid = _let(valid, lambda m: F.concat(_of_rank(m["l"]).cast("int").cast("string"), _of_rank(F.floor(m["r"] / 10000)).cast("int").cast("string"), _padded(m["r"] % 10000, 4)))
    other = _feistel(key, tweak, area % 100 * 100 + exchange % 100, line, 10000, 10000)
    other = _let(other, lambda m: F.concat(F.substring(ten, 1, 1), _padded(F.floor(m["l"] / 100), 2), F.substring(ten, 4, 1), _padded(m["l"] % 100, 2), _padded(m["r"], 4)))
    new = F.when((code == "") & _exists(area) & _exists(exchange), valid).when((code == "") & (attempt <= PATIENCE), other).otherwise(permuted_digits(key, tweak, ten))
    return F.concat(code, F.lit(":"), new)


def _ssn(key: str, v: Column, attempt: Column) -> Column:
    """v: nine digits. Areas 000, 666 and from 900, group 00 and serial 0000 do not exist."""
    area, group, serial = F.substring(v, 1, 3).cast("int"), F.substring(v, 4, 2).cast("int"), F.substring(v, 6, 4).cast("int")
    tweak = F.concat(F.lit("ssn"), attempt.cast("string"))
    exists = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    valid = _feistel(key, tweak, (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
    valid = _let(valid, lambda m: _let(F.floor(m["l"] / 99) + 1, lambda a: F.concat(_padded(a + F.when(a >= 666, 1).otherwise(0), 3), _padded(m["l"] % 99 + 1, 2), _padded(m["r"] + 1, 4))))
    other = F.concat(F.substring(v, 1, 3), permuted_digits(key, F.concat(tweak, F.substring(v, 1, 3)), F.substring(v, 4, 6)))
    return F.when(exists, valid).when(attempt <= PATIENCE, other).otherwise(permuted_digits(key, tweak, v))


def _ipv4(key: str, v: Column, attempt: Column) -> Column:
    o = [F.split_part(v, F.lit("."), F.lit(i + 1)).cast("long") for i in range(4)]
    tweak = F.concat(F.lit("ipv4"), attempt.cast("string"))
    low = o[2] * 256 + o[3]
    joined = lambda a, b, r: F.concat_ws(".", *[x.cast("int").cast("string") for x in (a, b, F.floor(r / 256), r % 256)])
    within = lambda name, rank, size, back: _let(_feistel(key, F.concat(tweak, F.lit(name)), rank, low, size, 65536), lambda m: joined(*back(m["l"]), m["r"]))
    #: Public first octets: 1 to 223 but 10, 127, 172 and 192, which are partly or wholly something else.
    skipped = lambda n: n + 1 + F.when(n + 1 >= 10, 1).otherwise(0) + F.when(n + 1 >= 126, 1).otherwise(0) + F.when(n + 1 >= 170, 1).otherwise(0) + F.when(n + 1 >= 189, 1).otherwise(0)
    rank = o[0] - 1 - sum((F.when(o[0] > x, 1).otherwise(0) for x in (127, 172, 192)), F.when(o[0] > 10, 1).otherwise(0))
    any_ = within("any", o[0] * 256 + o[1], 65536, lambda x: (F.floor(x / 256), x % 256))
    return (
        F.when(attempt > PATIENCE, any_)
        .when((o[0] == 192) & (o[1] == 168), _let(_feistel(key, F.concat(tweak, F.lit("192.168")), o[2], o[3], 256, 256), lambda m: joined(o[0], o[1], m["l"] * 256 + m["r"])))
        .when((o[0] == 172) & o[1].between(16, 31), within("172.16", o[1] - 16, 16, lambda x: (o[0], x + 16)))
        .when(o[0] == 172, within("172", o[1] - F.when(o[1] > 31, 16).otherwise(0), 240, lambda x: (o[0], x + F.when(x > 15, 16).otherwise(0))))
        .when(o[0] == 192, within("192", o[1] - F.when(o[1] > 168, 1).otherwise(0), 255, lambda x: (o[0], x + F.when(x >= 168, 1).otherwise(0))))
        .when(o[0].isin(0, 10, 127) | (o[0] > 223), _let(F.concat(F.lit("first"), o[0].cast("string")), lambda name: _let(_feistel(key, F.concat(tweak, name), o[1], low, 256, 65536), lambda m: joined(o[0], m["l"], m["r"]))))
        .otherwise(within("public", rank * 256 + o[1], 219 * 256, lambda x: (skipped(F.floor(x / 256)), x % 256)))
    )


def _stream(key: str, kind: str, v: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), attempt.cast("string"), v), 512)


def _classes(text: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Each letter and digit by one of its class, from pairs of hexadecimal digits of stream (128 of them)."""
    def swap(c, i):
        byte = _number(stream, (i % 64) * 2 + 1, 2)
        if hexadecimal:
            return F.when(c.rlike("[0-9A-Fa-f]"), F.substr(stream, (i % 64) * 2 + 1, F.lit(1))).otherwise(c)
        low, high = (F.chr(F.lit(a) + byte % 26) for a in (97, 65))
        return F.when(c.between("a", "z"), low).when(c.between("A", "Z"), high).when(c.between("0", "9"), (byte % 10).cast("string")).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def _email(key: str, v: Column, attempt: Column) -> Column:
    """Of any case of v: equal but for case, whatever the case."""
    stream = _stream(key, "email", F.lower(v), attempt)
    head = F.regexp_extract(v, r"^(.*@(?:.*\.(?=[^.]*\.[^.]*$))?)([^.]*)\.([^.]*)$", 1)
    end = F.lower(F.regexp_extract(v, r"\.([^.]*)$", 1))
    extra = F.when(attempt > 8, F.concat(F.substring(stream, 100, 6), F.lit("."))).otherwise(F.lit(""))  # a shape too short for its values grows
    return F.concat(_classes(head, stream), extra, F.lit("example."), F.when(end.isin("com", "net", "org"), end).otherwise(F.lit("org")))


def _secret(key: str, v: Column, attempt: Column) -> Column:
    return F.substr(_stream(key, "secret", v, attempt), F.lit(1), F.length(v))


def _ipv6(key: str, v: Column, attempt: Column) -> Column:
    stream = _stream(key, "ipv6", v, attempt)
    head = F.regexp_extract(v, "^[0-9a-f]*", 0)
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.substr(stream, i * 4 + 1, F.lit(4))), ":")
    return F.when(attempt <= PATIENCE, F.concat(head, _classes(F.substr(v, F.length(head) + 1, F.length(v)), stream, hexadecimal=True))).otherwise(F.concat(F.when(head == "", "0").otherwise(head), F.lit(":"), groups))


def _iban(key: str, v: Column, attempt: Column) -> Column:
    """v: without blanks."""
    body = F.substr(v, F.lit(5), F.length(v))
    country = F.substring(v, 1, 2)
    return _let(_classes(body, _stream(key, "iban", v, attempt)), lambda b: F.concat(country, _padded(98 - _remainder_97(F.concat(b, country, F.lit("00"))), 2), b))


def _map(table: dict) -> Column:
    return F.create_map(*[x for k, words in table.items() for x in (F.lit(k), F.array(*map(F.lit, words)) if isinstance(words, list) else F.lit(words))])


def _named(key: str, kind: Column, v: Column, attempt: Column) -> Column:
    """kind: given:<script>:<gender> or a key of ENDINGS. A given name comes from a list, with a syllable for each attempt; a surname has two syllables and one more for each attempt."""
    hexed = _hash(key, kind, attempt.cast("string"), v)
    pick = lambda words, at: F.element_at(words, (_number(hexed, at, 4) % F.size(words) + 1).cast("int"))
    sounds = _map(SYLLABLES)[F.split_part(kind, F.lit(":"), F.lit(2))]
    syllables = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: pick(sounds, i * 4 + 1)), "")
    given = F.concat(pick(_map(GIVEN)[kind], 1), F.when(attempt > 0, syllables(F.least(attempt, F.lit(14)))).otherwise(F.lit("")))
    surname = _let(syllables(F.least(attempt + 2, F.lit(14))), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2), F.length(s)), _map(ENDINGS)[kind]))
    return F.when(F.startswith(kind, F.lit("given")), given).otherwise(surname)


def surrogate(key: str, kind: Column, v: Column, attempt: Column) -> Column:
    """Of a value's key, as compared. Kinds: the types, and those of names."""
    out = _named(key, kind, v, attempt)
    for name, made in (("email", _email), ("secret", _secret), ("iban", _iban), ("phone", _phone), ("ssn", _ssn), ("card", _card), ("ipv4", _ipv4), ("ipv6", _ipv6)):
        out = F.when(kind == name, made(key, v, attempt)).otherwise(out)
    return out


# --- detection -----------------------------------------------------------------------------------------------------------


def _type(v: Column) -> Column:
    out = F.lit("name")
    for name, _, pattern in reversed(PATTERNS):
        right = passes_luhn(v) if name == "card" else passes_97(v) if name == "iban" else None
        hit = v.rlike(f"^(?:{pattern})$")
        out = F.when(hit, F.lit(name) if right is None else F.when(right, name).otherwise("none")).otherwise(out)
    return out


def _script(v: Column) -> Column:
    return F.when(v.rlike(r"\p{IsCyrillic}"), "cyrillic").when(v.rlike(r"\p{IsGreek}"), "greek").when(v.rlike(r"\p{IsArmenian}"), "armenian").otherwise("latin")


def _gender_of_title(title: Column) -> Column:
    """m, f or null."""
    has = lambda g: title.rlike(r"(?:^| )(?:" + "|".join(TITLES[g]) + r")\.? ")
    return F.when(has("f"), "f").when(has("m"), "m")


def _gender_of_form(given: Column) -> Column:
    script = _script(given)
    female = F.when(script == "latin", given.rlike("[aeiyh]$")).when(script == "cyrillic", given.rlike("[ая]$")).when(script == "greek", ~given.rlike("ς$")).otherwise(False)
    return F.when(given.isin(MALE), "m").when(given.isin(FEMALE), "f").when(female, "f").otherwise("m")


_TITLES_AND_REST = rf"^((?:{_TITLE})*)(.*)$"
_IS_NAME = r"^\p{Lu}.*[^.]$"


def _words(name: Column) -> Column:
    return F.split(F.regexp_extract(name, _TITLES_AND_REST, 2), " ")


def _document_names(titled: Column) -> Column:
    """Of the titled names of a document: givens (word and gender) and surnames."""
    def givens(x):
        gender = _gender_of_title(F.regexp_extract(x, _TITLES_AND_REST, 1))
        return _let(_words(x), lambda w: F.transform(F.filter(F.slice(w, F.lit(1), F.size(w) - 1), lambda t: t.rlike(_IS_NAME)), lambda t: F.struct(t.alias("word"), F.coalesce(gender, _gender_of_form(t)).alias("gender"))))

    return F.struct(F.flatten(F.transform(titled, givens)).alias("givens"), F.array_distinct(F.transform(titled, lambda x: F.element_at(_words(x), -1))).alias("surnames"))


def _name_parts(v: Column, names: Column) -> Column:
    """kind, value (as compared), tail (what follows the surrogate) of each word of a name."""
    part = lambda kind, value, tail="": F.struct(kind.alias("kind"), value.alias("value"), (F.lit(tail) if isinstance(tail, str) else tail).alias("tail"))

    def of(word, last, many):
        known = F.element_at(F.filter(names["givens"], lambda g: g["word"] == word), 1)
        script = _script(word)
        inflected = word.rlike(_FEMININE) | word.rlike(_FEMININE.replace("а$", "$"))
        surname = (
            F.when((script == "cyrillic") & inflected, part(F.lit("surname:cyrillic:inflected"), F.regexp_replace(word, "а$", ""), F.when(word.rlike(_FEMININE), "а").otherwise("")))
            .when(script == "cyrillic", part(F.lit("surname:cyrillic:plain"), word))
            .when(script == "greek", part(F.when(word.rlike("ς$"), "surname:greek:m").otherwise("surname:greek:f"), word))
            .otherwise(part(F.concat(F.lit("surname:"), script), word))
        )
        given = part(F.concat_ws(":", F.lit("given"), script, known["gender"]), word)
        is_given = (F.size(F.filter(names["givens"], lambda g: g["word"] == word)) > 0) & ~(last & many & F.array_contains(names["surnames"], word))
        return F.when(~word.rlike(_IS_NAME), part(F.when(word.rlike(r"\.$"), "initial").otherwise("particle"), word)).when(is_given, given).otherwise(surname)

    return _let(_words(v), lambda w: F.transform(w, lambda word, i: of(word, i == F.size(w) - 1, F.size(w) > 1)))


def _parts(kind: Column, v: Column, names: Column) -> Column:
    digits = _digits(v)
    #: The last ten digits are the number, what stands before them the country code.
    code, national = F.substr(digits, F.lit(1), F.length(digits) - 10), F.substr(digits, F.length(digits) - 9, F.lit(10))
    value = (
        F.when(kind == "phone", F.concat(F.when(code == "1", "").otherwise(code), F.lit(":"), national))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(v, F.lit(" ")))
        .when(kind == "ipv4", v)
        .otherwise(F.lower(v))
    )
    none = F.array().cast("array<struct<kind:string,value:string,tail:string>>")
    return F.when(kind == "name", _name_parts(v, names)).when(kind == "none", none).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"), F.lit("").alias("tail"))))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash, gaps, spans (array of type, value, parts) of every document; a span of type none stays as it is."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("titled", F.when(F.col("text").rlike(TITLE_TEST), F.regexp_extract_all("text", F.lit(TITLED), F.lit(0))).otherwise(none))
    rows = rows.withColumn("names", _document_names(F.col("titled")))
    words = F.array_join(F.array_distinct(F.concat(F.col("names.surnames"), F.transform("names.givens", lambda g: g["word"]))), "|")
    again = F.concat(F.lit(r"(?<![\p{L}\p{N}]|\p{L}[-'’])(?=\p{Lu})(?:"), words, F.lit(r")(?: (?:\p{Lu}\. )?(?:"), words, F.lit(r"))*(?![\p{L}\p{N}]|-\p{L})"))
    by_test = [F.when(F.contains("text", F.lit(test)) if test == "@" else F.col("text").rlike(test), F.lit(f"(?:{pattern})")) for _, test, pattern in PATTERNS]
    by_name = F.when(F.size("titled") > 0, F.concat(F.lit(f"(?:{TITLED})|(?:"), again, F.lit(")")))
    rows = rows.withColumn("pattern", F.concat_ws("|", *by_test, by_name))
    rows = rows.withColumn("values", F.when(F.col("pattern") != "", F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(none))
    rows = rows.withColumn("gaps", F.when(F.size("values") > 0, F.split("text", F.col("pattern"), F.lit(-1))).otherwise(F.array("text")))
    span = lambda v: _let(_type(v), lambda kind: F.struct(kind.alias("type"), v.alias("value"), _parts(kind, v, F.col("names")).alias("parts")))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), "gaps", F.transform("values", span).alias("spans"))


# --- one surrogate for each value ------------------------------------------------------------------------------------------


def _checked(spans: str) -> Column:
    """The distinct kinds and values of a document that need a surrogate of their own."""
    parts = F.filter(F.flatten(F.transform(spans, lambda s: s["parts"])), lambda p: ~p["kind"].isin("initial", "particle"))
    return F.array_distinct(F.transform(parts, lambda p: F.struct(p["kind"], p["value"])))


def settle(found: DataFrame, key: str) -> DataFrame:
    """kind, value, attempt of every value: the attempts of one space (a type; all names) give different surrogates, none of them a value that occurs."""
    space = F.when(F.col("kind").rlike("^(?:given|surname):"), "name").otherwise(F.col("kind"))
    values = found.select(F.explode(_checked("spans")).alias("x")).select("x.kind", "x.value").distinct().withColumn("space", space)
    movers = materialize(values.withColumn("attempt", F.lit(0)), "values")
    real = movers.select(F.col("space").alias("rs"), F.lower("value").alias("rv")).distinct()
    settled = None
    while True:
        made = materialize(movers.withColumn("s", F.lower(surrogate(key, F.col("kind"), F.col("value"), F.col("attempt")))), "tried")
        taken = real if settled is None else real.unionByName(settled.select(F.col("space").alias("rs"), F.col("s").alias("rv")))
        first = made.groupBy(F.col("space").alias("fs"), F.col("s").alias("ft")).agg(F.min(F.struct("kind", "value")).alias("first"))
        free = made.join(taken, (made.space == taken.rs) & (made.s == taken.rv), "left_anti")
        won = materialize(free.join(first, (free.space == first.fs) & (free.s == first.ft) & (F.struct("kind", "value") == first["first"])).select(*made.columns), "settled")
        settled = won if settled is None else settled.unionByName(won)
        w = won.select(F.col("kind").alias("wk"), F.col("value").alias("wv"))
        movers = materialize(made.join(w, (made.kind == w.wk) & (made.value == w.wv), "left_anti").select("kind", "value", "space", (F.col("attempt") + 1).alias("attempt")), "movers")
        if movers.isEmpty():
            return settled.select("kind", "value", "attempt")


def replace_all(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text (with surrogates), n_entities, types (comma-joined in order)."""
    found = materialize(detect(docs), "spans")
    moved = settle(found, key).filter("attempt > 0")
    hit = found.filter(F.size("spans") > 0)
    if moved.isEmpty():
        hit = hit.withColumn("tries", F.lit(None).cast("map<string,int>"))
    else:
        parts = hit.select("doc_id", "text_hash", F.explode(_checked("spans")).alias("x"))
        m = moved.select(F.col("kind").alias("k"), F.col("value").alias("v"), "attempt")
        tries = parts.join(m, (F.col("x.kind") == m.k) & (F.col("x.value") == m.v)).groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "k", "v"), "attempt"))).alias("tries"))
        t = tries.select(F.col("doc_id").alias("td"), F.col("text_hash").alias("th"), "tries")
        hit = hit.join(t, hit.doc_id.eqNullSafe(t.td) & (hit.text_hash == t.th), "left")

    def attempt(p):
        return F.coalesce(F.col("tries")[F.concat_ws("|", p["kind"], p["value"])], F.lit(0))

    def word(p):
        """Initials become another letter: a step of 1 to 16 on from their place."""
        letters = F.when(_script(p["value"]) == "cyrillic", F.lit("АБВГДЕЗИКЛМНОПРСТФ")).when(_script(p["value"]) == "greek", F.lit("ΑΒΓΔΕΖΗΘΙΚΛΜΝΟΠΡΣΤ")).otherwise(F.lit("ABCDEFGHIJKLMNOPRST"))
        at = F.pmod(F.position(F.substring(p["value"], 1, 1), letters) + _number(_hash(key, F.lit("initial"), p["value"]), 1, 4) % 16, F.length(letters)) + 1
        return F.when(p["kind"] == "particle", p["value"]).when(p["kind"] == "initial", F.concat(F.substr(letters, at.cast("int"), F.lit(1)), F.lit("."))).otherwise(F.concat(_named(key, p["kind"], p["value"], attempt(p)), p["tail"]))

    def new(span):
        v, kind, p = span["value"], span["type"], F.element_at(span["parts"], 1)
        made = surrogate(key, kind, p["value"], attempt(p))
        return (
            F.when(kind == "none", v)
            .when(kind == "name", F.concat(F.regexp_extract(v, _TITLES_AND_REST, 1), F.array_join(F.transform(span["parts"], word), " ")))
            .when(kind == "email", _email(key, v, attempt(p)))
            .when(kind == "phone", _let(made, lambda s: F.concat(F.regexp_extract(v, r"^(\+[0-9]{1,3}[ -]?)?", 0), in_format(F.regexp_replace(v, r"^\+[0-9]{1,3}[ -]?", ""), F.split_part(s, F.lit(":"), F.lit(2))))))
            .when(kind.isin("ssn", "card"), _let(made, lambda s: in_format(v, s)))
            .when(kind == "iban", _let(made, lambda s: in_format(v, s, "[0-9A-Z]")))
            .otherwise(F.when(v.rlike("[A-F]"), F.upper(made)).otherwise(made))
        )

    entities = F.filter("spans", lambda s: s["type"] != "none")
    text = F.array_join(F.zip_with("gaps", F.transform("spans", new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = hit.select("doc_id", text.alias("text"), F.size(entities).cast("long").alias("n_entities"), F.array_join(F.transform(entities, lambda s: s["type"]), ",").alias("types"))
    rest = found.filter(F.size("spans") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("types"))
    return rest.unionByName(changed)
