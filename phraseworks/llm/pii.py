"""Personal information in free text (problem 3): find it, and replace it with typed placeholders.

Method: regular expressions propose spans; checksum validators (Luhn for national numbers, mod-97 for bank account numbers,
which are business data and block what overlaps them) confirm or weaken them; words nearby move the score; spans at or
above the threshold count, overlaps go to the higher score, then the longer span. Patterns run on the consistent form of
the text (see ``glyphs``), spans are carried back to the text as it stands.

Names have an open vocabulary. A proposal is anything of a name's shape (``Given Family``, ``Family, Given``, initials); its
score is the sum of what speaks for it: capitals, a title, a word that persons follow (``by``, ``contact``, ``dear``), a
closing line, what follows (an address, a telephone, ``lives at``), parts that are known names; and against it: words of
organisations, places and dates, or a company word behind it. Two passes: the first reads, over all documents, the parts
of names whose context alone suffices, and the towns before postal codes; those held by two different documents at least
(re-sent rows are one document), with the given list of names, are the lexicon of the second. Up to ``MAX_LEXICON`` parts
(about 10 MB) it is replicated; a larger one is joined to the texts by what each may look up, with the same result.

Defined results: null gives null and no spans; empty texts have none; a document's row is found per distinct string and
kind; re-sent rows count once; texts of any length are read whole; nothing but the found spans changes.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseworks.llm.glyphs import Alikes, confusables, consistent_batch, pieces, suspect
from phraseworks.session import cut_lineage

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
THRESHOLD = 0.5
MAX_LEXICON = 100_000
#: Characters of context on either side of a span.
NEAR = 40
#: Characters a name may reach before or behind a known part of it.
LONGEST_NAME = 80

D = "[0-9٠-٩۰-۹]"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
#: The sign or words between the parts of an address; local part and domain are read from there to either side.
AT = re.compile(r"@|\s*[(\[{<]\s*at\s*[)\]}>]\s*|\s+at\s+(?=[A-Za-z0-9-]+\s+dot\s)", re.I)
#: Without the sign, "dot" or this, no AT leads to an address.
BRACKETED_AT = re.compile(r"[(\[{<]\s*at\s*[)\]}>]", re.I)
LOCAL = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*$")
DOMAIN = re.compile(rf"{LABEL}(?:(?:\.|\s*[(\[{{<]\s*dot\s*[)\]}}>]\s*|\s+dot\s+){LABEL})+", re.I)
EXTENSION = rf"(?:[ ,]*(?:ext\.?|extension|x|تحويلة|داخلي)[ .:]*{D}{{1,6}})?"
PHONE = re.compile(
    rf"(?<![\w+./-])(?:\+{D}{{8,15}}|\+{D}{{1,3}}[ .-]?\(?{D}{{1,4}}\)?[ .-]?{D}{{3,4}}[ .-]?{D}{{3,4}}|\+{D}{{1,3}}[ .-]{D}(?:[ .-]{D}{{2}}){{4}}|\+{D}{{1,3}}(?:[ .-]{D}{{2}}){{4}}"
    rf"|00{D}{{2,3}}(?:[ .-]{D}{{2,4}}){{2,4}}"
    rf"|\({D}{{2,4}}\)[ .-]?{D}{{3}}[ .-]{D}{{3,4}}"
    rf"|{D}{{3}}\.{D}{{3}}\.{D}{{4}}|{D}{{3}}-{D}{{3}}-{D}{{4}}"
    rf"|[0٠۰]{D}{{2,4}}[ -]{D}{{3,4}}[ -]{D}{{3,4}}"
    rf"|[0٠۰]{D}{{8,10}}){EXTENSION}(?![\w@]|[-./]{D})",
    re.I,
)
#: Digits in any grouping: a telephone where the word before says so.
LABELLED = re.compile(rf"(?<![\w+./-])\+?\(?{D}(?:[ .()-]{{0,2}}{D}){{6,14}}{EXTENSION}(?![\w@]|[-./]{D})", re.I)
PHONE_BEFORE = re.compile(r"(?:\b(?:tel|telephone|phone|mobile|cell|fax|call|dial|whatsapp)\b|هاتف|جوال|اتصل)[\s.:#-]*(?:no\b|number\b|at\b|on\b|me\b|us\b|على)?[\s.:#]*(?:at\b|on\b)?\s*$", re.I)
#: A telephone word and what stands before the number it announces.
PHONE_WORD = re.compile(r"(?:\b(?:tel|telephone|phone|mobile|cell|fax|call|dial|whatsapp)\b|هاتف|جوال|اتصل)(?:[\s.:#-]|no\b|number\b|at\b|on\b|me\b|us\b|على)*(?=[+(0-9٠-٩۰-۹])", re.I)
DATE = re.compile(rf"{D}{{4}}[-.]{D}{{2}}[-.]{D}{{2}}$|{D}{{1,2}}[-.]{D}{{1,2}}[-.]{D}{{4}}$")
IDENTITY = re.compile(
    rf"(?<![\w./-])(?:(?P<national>[12١٢۱۲]-{D}{{4}}-{D}{{4}}-{D}|[12١٢۱۲]{D}{{9}})|(?P<social>{D}{{3}}(?P<s>[- ]){D}{{2}}(?P=s){D}{{4}})|(?P<passport>[A-Z]{{1,2}}[- ]?{D}{{7}})|(?P<bare>{D}{{6,15}}))(?![\w@]|[-./]{D})"
)
ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
ID_BEFORE = re.compile(r"(?:\bnational\s+id\b|\bssn\b|\bsocial\s+security\b|\bpassport\b|\bid\b|\bidentity\b|هوية|جواز|الضمان\s+الاجتماعي)[^\n]{0,18}$", re.I)
BUSINESS_BEFORE = re.compile(r"(?:\bserial\b|\breference\b|\bref\b|\bticket\b|\binvoice\b|\border\b|\bvendor\b|\bpo\b|\bpermit\b|\bagreement\b|\bemployee\s+id\b|\baccount\b|\biban\b|الوظيفي|الفاتورة|التسلسلي|المرجع|الحساب)[\s:#.no]*$", re.I)
NATIONAL_BEFORE = re.compile(r"(?:national\s+id|هوية|\bid)\W*(?:no\.?|number)?\W*$", re.I)
PASSPORT_BEFORE = re.compile(r"(?:passport|جواز|\bid)\W*(?:السفر|no\.?|number|رقم)?\W*$", re.I)
BARE_BEFORE = re.compile(r"(?:\bnational\s+id|\bidentity|\bssn|\bsocial\s+security|\bpassport|هوية|جواز)\W*(?:no\.?|number|card|رقم|السفر)?\W*$", re.I)
BUSINESS_PREFIX = frozenset(["PO", "CC", "WP", "INV", "EMP", "VND", "MSA", "PRJ"])

STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Crescent|Cres|Drive|Dr|Boulevard|Blvd|Way|Close|Place|Pl|Square|Sq|Terrace|Row)\b\.?"
NAMED = r"[A-Za-z][\w'’-]*(?:[ ][A-Za-z][\w'’-]*){0,2}?"
ROOM = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Villa|Floor|Room|Office)"
BREAK = r"(?:[ ]*,\s*|[ ]*\n\s*)"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?:{ROOM}[ ]+\d+[A-Za-z]?{BREAK})?(?:(?:Building|Bldg\.?|House|Villa)[ ]+\d+[A-Za-z]?{BREAK}|\d{{1,5}}[A-Za-z]?,?[ ]+){NAMED}[ ]+{STREET}(?:{BREAK}{ROOM}[ ]+\d+[A-Za-z]?)?"
    rf"|P\.?[ ]?O\.?[ ]?Box[ ]+\d+)(?P<sep>{BREAK})(?P<town>[^\W\d_][\w'’-]*(?:[ ][^\W\d_][\w'’-]*){{0,2}})",
    re.I,
)
ADDRESS_AR = re.compile(rf"(?<!\w)(?:(?:شقة|مبنى|بناية|عمارة|فيلا)\s+{D}+\s*[،,]\s*)?شارع\s+[^\W\d_]+(?:[ ][^\W\d_]+){{0,2}}?\s+{D}+(?P<sep>\s*[،,]\s*|[ ]*\n\s*)(?P<town>[^\W\d_]+(?:[ ][^\W\d_]+){{0,2}})")
BOX_AR = re.compile(rf"(?<!\w)(?:ص\.?\s?ب\.?|صندوق\s+بريد)\s+{D}+(?P<sep>\s*[،,]\s*|[ ]*\n\s*)(?P<town>[^\W\d_]+(?:[ ][^\W\d_]+){{0,2}})")
POSTCODE = re.compile(rf"[ ,،]{{1,2}}{D}{{5}}(?:-{D}{{4}})?(?![\w-])")

PART = r"(?:[^\W\d_؀-ۿ]['’])?[^\W\d_؀-ۿ]{2,}(?:[-'’][^\W\d_؀-ۿ]+)*"
ARABIC = re.compile(r"[؀-ۿ]")
PARTICLES = ("al", "el", "van", "de", "bin", "ibn")
FAMILY = rf"(?:(?:{'|'.join(PARTICLES)})[- ])?{PART}"
INITIAL = r"[^\W\d_؀-ۿ]\."
NAME = rf"(?:{FAMILY},[ ](?:{PART}(?:[ ]{INITIAL})?|{INITIAL}(?:[ ]?{INITIAL})?)|{PART}(?:[ ]{INITIAL})*[ ]{FAMILY}|(?:{INITIAL}[ ]?){{1,2}}{FAMILY})"
PART_AR = r"[ء-غف-ْ]{2,}"
GIVEN_AR = rf"(?!ال){PART_AR}"
NAME_AR = rf"(?:{GIVEN_AR}[ ]ال{PART_AR}|ال{PART_AR}[،,][ ]{GIVEN_AR})"
NAME_AT = re.compile(rf"{NAME}(?![\w@]|-\d)", re.I)
NAME_AR_AT = re.compile(rf"{NAME_AR}(?!\w)")
#: Two given names before a known family name.
THREE = re.compile(rf"{PART}[ ]{PART}[ ]{FAMILY}(?![\w@])", re.I)
#: Context words before a name by kind, what may stand between them and it, and how much each kind says.
CUE = {
    w: kind
    for kind, listed in {
        "title": "mr mrs ms miss mx dr prof professor eng sir madam sheikh judge captain capt rev",
        "close": "regards sincerely faithfully truly best wishes thanks cheers",
        "strong": "by contact call phone ask tell email e-mail dear attn attention interviewed interview met meet named name employee signatory witness applicant tenant caller author undersigned",
        "weak": "from to cc for of with and told asks notify",
    }.items()
    for w in listed.split()
}
GAP = {
    "title": re.compile(r"\.?[ ]+"),
    "close": re.compile(r"[,!.]?[ ]*\n\s*|[,!.][ ]+"),
    "strong": re.compile(r"(?:[ ]is)?[ ]*[.:,–-]*[ ]+"),
    "weak": re.compile(r"[:,]?[ ]+"),
}
BEFORE_AR = re.compile(
    r"(?<!\w)(?:(?P<title>(?:السيدة?|الآنسة)[ ])|(?P<strong>للتواصل[ ]مع[ ]|للموظفة?[ ]|(?:ال)?(?:اسم|إسم)[ ]?:?[ ]|باسم[ ]|اتصل[ ]ب)"
    r"|(?P<role>(?:المهندسة?|الدكتورة?|الأستاذة?)[ ])|(?P<weak>وقعت?[ ]|مع[ ]|من[ ]قبل[ ]|بواسطة[ ]))"
)
WEIGHT = {"title": 0.4, "close": 0.4, "strong": 0.35, "weak": 0.15, "none": 0.0}
WEIGHT_AR = {"title": 0.5, "strong": 0.4, "role": 0.3, "weak": 0.25, "none": 0.0}
#: What follows a name: an address in brackets, a telephone, a home.
AFTER = re.compile(r"[ ]\((?=[^()\s]{1,80}(?:@|[ ][(\[]at[)\]][ ]))|[ ](?:lives|resides)[ ]at[ ]|,[ ](?:tel|phone|mobile)\b|[ ](?:at|on)[ ](?=[+(]?\d[\d ().-]{6}|[^\s@]{1,64}@)", re.I)
AFTER_WORDS = {"lives": 1, "resides": 1, "tel": 2, "phone": 2, "mobile": 2, "at": 1, "on": 1}
CONTEXT = CUE.keys() | AFTER_WORDS.keys()
AFTER_WEAK = re.compile(r"[ ](?:said|says|asked|wrote|called|visited|signed|joined|left|resigned|confirmed|agreed)\b", re.I)
AFTER_AR = re.compile(r"[ ](?:على[ ](?:الرقم|البريد)|راجعت?[ ]|يسكن|تسكن|يقيم|تقيم)|[ ]\(")
NEXT = re.compile(r"[ ](?:and|&)[ ]", re.I)
NEXT_AR = re.compile(r"[ ](?:مع|و)[ ]?")
WORD = re.compile(r"(?:\b(?:tel|telephone|phone|mobile|cell|fax|call|dial|whatsapp)\b|هاتف|جوال|اتصل)(?:[\s.:#-]|no\b|number\b|at\b|on\b|me\b|us\b|على)*(?=[+(0-9٠-٩۰-۹])", re.I)
DATE = re.compile(rf"{D}{{4}}[-.]{D}{{2}}[-.]{D}{{2}}$|{D}{{1,2}}[-.]{D}{{1,2}}[-.]{D}{{4}}$")
IDENTITY = re.compile(
    rf"(?<![\w./-])(?:(?P<national>[12١٢۱۲]-{D}{{4}}-{D}{{4}}-{D}|[12١٢۱۲]{D}{{9}})|(?P<social>{D}{{3}}(?P<s>[- ]){D}{{2}}(?P=s){D}{{4}})|(?P<passport>[A-Z]{{1,2}}[- ]?{D}{{7}})|(?P<bare>{D}{{6,15}}))(?![\w@]|[-./]{D})"
)
ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
ID_BEFORE = re.compile(r"(?:\bnational\s+id\b|\bssn\b|\bsocial\s+security\b|\bpassport\b|\bid\b|\bidentity\b|هوية|جواز|الضمان\s+الاجتماعي)[^\n]{0,18}$", re.I)
BUSINESS_BEFORE = re.compile(r"(?:\bserial\b|\breference\b|\bref\b|\bticket\b|\binvoice\b|\border\b|\bvendor\b|\bpo\b|\bpermit\b|\bagreement\b|\bemployee\s+id\b|\baccount\b|\biban\b|الوظيفي|الفاتورة|التسلسلي|المرجع|الحساب)[\s:#.no]*$", re.I)
NATIONAL_BEFORE = re.compile(r"(?:national\s+id|هوية|\bid)\W*(?:no\.?|number)?\W*$", re.I)
PASSPORT_BEFORE = re.compile(r"(?:passport|جواز|\bid)\W*(?:السفر|no\.?|number|رقم)?\W*$", re.I)
BARE_BEFORE = re.compile(r"(?:\bnational\s+id|\bidentity|\bssn|\bsocial\s+security|\bpassport|هوية|جواز)\W*(?:no\.?|number|card|رقم|السفر)?\W*$", re.I)
BUSINESS_PREFIX = frozenset(["PO", "CC", "WP", "INV", "EMP", "VND", "MSA", "PRJ"])

STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Crescent|Cres|Drive|Dr|Boulevard|Blvd|Way|Close|Place|Pl|Square|Sq|Terrace|Row)\b\.?"
NAMED = r"[A-Za-z][\w'’-]*(?:[ ][A-Za-z][\w'’-]*){0,2}?"
ROOM = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Villa|Floor|Room|Office)"
BREAK = r"(?:[ ]*,\s*|[ ]*\n\s*)"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?:{ROOM}[ ]+\d+[A-Za-z]?{BREAK})?(?:(?:Building|Bldg\.?|House|Villa)[ ]+\d+[A-Za-z]?{BREAK}|\d{{1,5}}[A-Za-z]?,?[ ]+){NAMED}[ ]+{STREET}(?:{BREAK}{ROOM}[ ]+\d+[A-Za-z]?)?"
    rf"|P\.?[ ]?O\.?[ ]?Box[ ]+\d+)(?P<sep>{BREAK})(?P<town>[^\W\d_][\w'’-]*(?:[ ][^\W\d_][\w'’-]*){{0,2}})",
    re.I,
)
ADDRESS_AR = re.compile(rf"(?<!\w)(?:(?:شقة|مبنى|بناية|عمارة|فيلا)\s+{D}+\s*[،,]\s*)?شارع\s+[^\W\d_]+(?:[ ][^\W\d_]+){{0,2}}?\s+{D}+(?P<sep>\s*[،,]\s*|[ ]*\n\s*)(?P<town>[^\W\d_]+(?:[ ][^\W\d_]+){{0,2}})")
BOX_AR = re.compile(rf"(?<!\w)(?:ص\.?\s?ب\.?|صندوق\s+بريد)\s+{D}+(?P<sep>\s*[،,]\s*|[ ]*\n\s*)(?P<town>[^\W\d_]+(?:[ ][^\W\d_]+){{0,2}})")
POSTCODE = re.compile(rf"[ ,،]{{1,2}}{D}{{5}}(?:-{D}{{4}})?(?![\w-])")

PART = r"(?:[^\W\d_؀-ۿ]['’])?[^\W\d_؀-ۿ]{2,}(?:[-'’][^\W\d_؀-ۿ]+)*"
ARABIC = re.compile(r"[؀-ۿ]")
PARTICLES = ("al", "el", "van", "de", "bin", "ibn")
FAMILY = rf"(?:(?:{'|'.join(PARTICLES)})[- ])?{PART}"
INITIAL = r"[^\W\d_؀-ۿ]\."
NAME = rf"(?:{FAMILY},[ ](?:{PART}(?:[ ]{INITIAL})?|{INITIAL}(?:[ ]?{INITIAL})?)|{PART}(?:[ ]{INITIAL})*[ ]{FAMILY}|(?:{INITIAL}[ ]?){{1,2}}{FAMILY})"
PART_AR = r"[ء-غف-ْ]{2,}"
GIVEN_AR = rf"(?!ال){PART_AR}"
NAME_AR = rf"(?:{GIVEN_AR}[ ]ال{PART_AR}|ال{PART_AR}[،,][ ]{GIVEN_AR})"
NAME_AT = re.compile(rf"{NAME}(?![\w@]|-\d)", re.I)
NAME_AR_AT = re.compile(rf"{NAME_AR}(?!\w)")
#: Two given names before a known family name.
THREE = re.compile(rf"{PART}[ ]{PART}[ ]{FAMILY}(?![\w@])", re.I)
#: Context words before a name by kind, what may stand between them and it, and how much each kind says.
CUE = {
    w: kind
    for kind, listed in {
        "title": "mr mrs ms miss mx dr prof professor eng sir madam sheikh judge captain capt rev",
        "close": "regards sincerely faithfully truly best wishes thanks cheers",
        "strong": "by contact call phone ask tell email e-mail dear attn attention interviewed interview met meet named name employee signatory witness applicant tenant caller author undersigned",
        "weak": "from to cc for of with and told asks notify",
    }.items()
    for w in listed.split()
}
GAP = {
    "title": re.compile(r"\.?[ ]+"),
    "close": re.compile(r"[,!.]?[ ]*\n\s*|[,!.][ ]+"),
    "strong": re.compile(r"(?:[ ]is)?[ ]*[.:,–-]*[ ]+"),
    "weak": re.compile(r"[:,]?[ ]+"),
}
BEFORE_AR = re.compile(
    r"(?<!\w)(?:(?P<title>(?:السيدة?|الآنسة)[ ])|(?P<strong>للتواصل[ ]مع[ ]|للموظفة?[ ]|(?:ال)?(?:اسم|إسم)[ ]?:?[ ]|باسم[ ]|اتصل[ ]ب)"
    r"|(?P<role>(?:المهندسة?|الدكتورة?|الأستاذة?)[ ])|(?P<weak>وقعت?[ ]|مع[ ]|من[ ]قبل[ ]|بواسطة[ ]))"
)
WEIGHT = {"title": 0.4, "close": 0.4, "strong": 0.35, "weak": 0.15, "none": 0.0}
WEIGHT_AR = {"title": 0.5, "strong": 0.4, "role": 0.3, "weak": 0.25, "none": 0.0}
#: What follows a name: an address in brackets, a telephone, a home.
AFTER = re.compile(r"[ ]\((?=[^()\s]{1,80}(?:@|[ ][(\[]at[)\]][ ]))|[ ](?:lives|resides)[ ]at[ ]|,[ ](?:tel|phone|mobile)\b|[ ](?:at|on)[ ](?=[+(]?\d[\d ().-]{6}|[^\s@]{1,64}@)", re.I)
AFTER_WORDS = {"lives": 1, "resides": 1, "tel": 2, "phone": 2, "mobile": 2, "at": 1, "on": 1}
CONTEXT = CUE.keys() | AFTER_WORDS.keys()
AFTER_WEAK = re.compile(r"[ ](?:said|says|asked|wrote|called|visited|signed|joined|left|resigned|confirmed|agreed)\b", re.I)
AFTER_AR = re.compile(r"[ ](?:على[ ](?:الرقم|البريد)|راجعت?[ ]|يسكن|تسكن|يقيم|تقيم)|[ ]\(")
NEXT = re.compile(r"[ ](?:and|&)[ ]", re.I)
NEXT_AR = re.compile(r"[ ](?:مع|و)[ ]?")
NAME_BEFORE = re.compile(rf"(?<![\w.,-]){NAME}$", re.I)
WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
COMPANY_AFTER = re.compile(r"^[ ,]*(?:holding|group|trading|consulting|contracting|engineering|industrial|supplies|utilities|freight|services|water|power|systems|works|partners|house|llc|ltd|est|co|inc|corp|gmbh|station|yard|field|basin|ridge|terminal|depot)\b", re.I)
#: Words that no part of a person's name is: function words, titles, and words of organisations, places and dates.
NO_NAME = frozenset(
    "mr mrs ms miss mx dr eng prof sir madam dear regards and or the for attn ask by cc to of in on at from with a an this that these those we you he she they it his her our your their my no not all any each every "
    "id ids ssn tel fax mobile passport emergency interviewed interview prepared written signed approved reviewed kept copied sent met meet tell phone email name named reach cell note notes re fwd subject from date "
    "both please thanks best sincerely when while if as once until unless after before because although though since so than then there here who what which how why yes hello hi good see call contact "
    "is are was were be been has have had do does did will would can could may might must shall should".split()
) | frozenset(
    "affairs audit auditor authority accounts account agency assets asset assurance bank block board branch building bureau capital center centre client clinic college committee company consulting contracting controls "
    "control corporation council customer data department depot desk division engineering enterprise facilities facility field finance foundation freight fund governance group hiring holding hospital hotel house human "
    "industrial institute integrity internal laboratory legal limited logistics management manager marketing ministry office officer operations partners payable payroll permit planning plant police port procurement project "
    "purchasing quality receivable resources safety sales school security service services site society staff station store supplies support systems team technical technology terminal trading treasury union unit university "
    "utilities vendor warehouse water works yard zone basin ridge wadi umm qasr street road avenue lane court drive box floor room annex appendix section article clause table figure page version invoice order agreement "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december today tomorrow yesterday morning evening".split()
)
#: Words of ``NO_NAME`` that persons are called too: behind a title or a closing line they only weaken a name.
ALSO_NAMES = frozenset("will may april june august page lane field house court bank port block ridge yard basin water".split())
NO_NAME_AR = frozenset(
    "حسب بعد قبل خلال ضمن فوق تحت حول دون بين مع على عن من إلى الى في عند لدى منذ حتى كما بينما عندما لأن لكن حيث ثم أو او بموجب جانب هذا هذه ذلك تلك كل بعض غير قد لم لن إن أن كان كانت "
    "قسم إدارة ادارة مركز شركة مؤسسة وزارة هيئة بنك ميناء محطة مبنى مدير فريق لجنة مشروع عقد أمر رقم فاتورة تصريح شارع وادي قصر حوض حقل ساحة أم مدينة".split()
)


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


class Lexicon(NamedTuple):
    given: frozenset[str]
    family: frozenset[str]
    towns: frozenset[str]


def digits(text: str) -> str:
    return "".join(str(unicodedata.digit(c)) for c in text if c.isdigit())


def luhn(number: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(number)))
    return total % 10 == 0


def mod97(account: str) -> bool:
    flat = account.replace(" ", "").upper()
    return len(flat) >= 15 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def fold(part: str) -> str:
    return part.lower().replace("’", "'")


def split_name(name: str) -> tuple[str, str]:
    """``(given, family)`` of a name in any of its shapes, folded; given is empty for an initial."""
    comma = "،" if "،" in name else ","
    if comma in name:
        family, _, given = name.partition(comma)
    else:
        *rest, family = name.replace(". ", ".").replace(".", ". ").split()
        given = " ".join(rest)
        if len(rest) > 1 and rest[-1].lower() in ("al", "el", "van", "de", "bin", "ibn"):
            family, given = f"{rest[-1]} {family}", " ".join(rest[:-1])
    first = next((w for w in given.split() if not w.endswith(".")), "")
    bare = re.sub(r"^(?:al|el)[- ]", "", family.strip(), flags=re.I)
    return fold(first), fold(bare)


#: Where a number may begin: one scan by what all patterns share, these are tried there with lookbehinds of their own.
NUMBER_START = re.compile(r"(?:[+(\d]|[A-Z](?=[A-Z]?[- ]?\d))(?<!\w.)")
#: What may stand before the number of a room, building or box; an address begins there.
BEFORE_NUMBER = re.compile(rf"(?<![\w-])(?:{ROOM}|Building|Bldg\.?|House|P\.?[ ]?O\.?[ ]?Box)[ ]+$", re.I)


def _at_starts(text: str, starts: list[int], pattern: re.Pattern) -> Iterator[re.Match]:
    """Matches at the given places, without overlaps."""
    end = 0
    for at in starts:
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            yield m


def number_starts(text: str) -> list[int]:
    return [m.start() for m in NUMBER_START.finditer(text)]


def _numbers(text: str, starts: list[int], announced: list[int]) -> Iterator[Span]:
    capitals = [at for at in starts if text[at].isalpha()]
    blocked = [m.span() for m in _at_starts(text, capitals, ACCOUNT) if mod97(m.group())]

    def free(m: re.Match) -> bool:
        return not any(m.start() < b and a < m.end() for a, b in blocked)

    for m in _at_starts(text, [at for at in starts if not text[at].isalpha()], PHONE):
        n = len(digits(re.split(r"(?i)ext|x|تحويلة|داخلي", m.group())[0]))
        if free(m) and 7 <= n <= 15:
            before = text[max(0, m.start() - NEAR) : m.start()]
            score = 0.7 - 0.5 * bool(BUSINESS_BEFORE.search(before)) - 0.3 * bool(NATIONAL_BEFORE.search(before))
            yield Span(m.start(), m.end(), "phone", score)
    for start in announced:
        at = label.end() if (label := PHONE_WORD.match(text, start)) else len(text)
        if (m := LABELLED.match(text, at)) and free(m) and PHONE_BEFORE.search(text, max(0, at - NEAR), at) and not DATE.match(m.group()):
            yield Span(m.start(), m.end(), "phone", 0.6)
    for m in _at_starts(text, starts, IDENTITY):
        if not free(m):
            continue
        before = text[max(0, m.start() - NEAR) : m.start()]
        business = bool(BUSINESS_BEFORE.search(before))
        if m["national"]:
            score = 0.3 + 0.1 * luhn(digits(m.group())) + 0.1 * ("-" in m.group()) + 0.4 * bool(ID_BEFORE.search(before)) - 0.6 * business
        elif m["social"]:
            score = 0.5 + 0.3 * bool(ID_BEFORE.search(before)) - 0.5 * business
        elif m["bare"]:
            score = 0.1 + 0.5 * bool(BARE_BEFORE.search(before)) - 0.5 * business
        else:
            known = re.match(r"[A-Z]+", m.group()).group() not in BUSINESS_PREFIX
            score = (0.3 + 0.5 * bool(PASSPORT_BEFORE.search(before)) - 0.5 * business) * known
        yield Span(m.start(), m.end(), "id_number", score)


def _town_end(text: str, m: re.Match, towns: frozenset[str]) -> tuple[int, int]:
    """Ends of the town and of the address: the words before a postal code, else the longest known town, else a guess from case."""
    at = m.start("town")
    words = [x for x in re.finditer(r"[^\W\d_][\w'’-]*", text[at : m.end("town")])]
    for k in range(1, len(words) + 1):
        end = at + words[k - 1].end()
        if code := POSTCODE.match(text, end):
            return end, code.end()
    for k in range(len(words), 0, -1):
        if " ".join(fold(w.group()) for w in words[:k]) in towns:
            end = at + words[k - 1].end()
            return end, end
    two = len(words) > 1 and words[1].group()[0].isupper() and not re.match(r"[ ]+[^\W\d_]*[a-z]", text[at + words[1].end() :])
    end = at + words[1 if two else 0].end()
    return end, end


def _address_matches(text: str, starts: list[int]) -> Iterator[re.Match]:
    """English addresses begin at a number or at the word before it."""
    end = 0
    for at in starts:
        if at < end or not text[at].isdigit():
            continue
        word = BEFORE_NUMBER.search(text, max(0, at - 16), at)
        m = (word and ADDRESS.match(text, word.start())) or ADDRESS.match(text, at)
        if m:
            end = m.end()
            yield m
    for words, pattern in ((("شارع",), ADDRESS_AR), (("ص.", "ص ب", "صندوق"), BOX_AR)):
        if any(w in text for w in words):
            yield from pattern.finditer(text)


def _addresses(text: str, starts: list[int], towns: frozenset[str]) -> Iterator[Span]:
    for m in _address_matches(text, starts):
        town_end, end = _town_end(text, m, towns)
        known = fold(text[m.start("town") : town_end]) in towns or end > town_end
        yield Span(m.start(), end, "address", 0.6 + 0.3 * known)


def _emails(text: str) -> Iterator[Span]:
    if "@" not in text and "dot" not in text.lower() and not BRACKETED_AT.search(text):
        return
    for m in AT.finditer(text):
        a = m.start()
        reach = 64
        while (local := LOCAL.search(text, max(0, a - reach), a)) and local.start() == a - reach > 0:
            reach *= 2
        if local and (domain := DOMAIN.match(text, m.end())):
            yield Span(local.start(), domain.end(), "email", 0.95)


NOTHING = Lexicon(frozenset(), frozenset(), frozenset())


def _initial(given: str, name: str) -> bool:
    return not given and "." in name


def name_score(text: str, a: int, b: int, context: float, lexicon: Lexicon) -> float:
    """The score of the name at ``text[a:b]``: ``context`` is what the words before it say."""
    name = text[a:b]
    given, family = split_name(name)
    words = [fold(w) for w in WORD.findall(name)]
    barred = [w for w in words if len(w) > 1 and w in NO_NAME and w not in PARTICLES]
    if not family or barred and (context < WEIGHT["title"] or not ALSO_NAMES.issuperset(barred)):
        return 0.0
    context -= 0.1 * len(barred)
    if COMPANY_AFTER.match(text[b : b + 24]):
        return 0.0
    known = 0.3 * (given in lexicon.given) + 0.25 * (family in lexicon.family)
    capitals = all(w[0].isupper() for w in WORD.findall(name) if w.lower() not in PARTICLES and not w.lower().startswith(("al-", "el-")))
    context += 0.3 * bool(AFTER.match(text, b)) + 0.15 * bool(AFTER_WEAK.match(text, b)) + 0.25 * _initial(given, name)
    if capitals:
        return context + known + 0.2
    return context + known - 0.2 * (known < 0.5 and not (_initial(given, name) and known))


def name_score_ar(text: str, a: int, b: int, context: float, lexicon: Lexicon) -> float:
    given, family = split_name(text[a:b])
    if given in NO_NAME_AR or given[1:] in NO_NAME_AR or family in NO_NAME_AR:
        return 0.0
    return 0.1 + context + 0.3 * (given in lexicon.given) + 0.25 * (family in lexicon.family) + 0.2 * bool(AFTER_AR.match(text, b))


#: What a listed word is good for.
IN_CONTEXT, KNOWN, TELEPHONE = 1, 2, 4
PHONE_WORDS = frozenset("tel telephone phone mobile cell fax call dial whatsapp هاتف جوال اتصل".split())


@functools.lru_cache(maxsize=4)
def _automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    """All context words and known parts of names, to be found in one pass over a text."""
    uses: dict[str, int] = {}
    for use, listed in ((IN_CONTEXT, CONTEXT), (KNOWN, lexicon.given), (KNOWN, lexicon.family), (TELEPHONE, PHONE_WORDS)):
        for w in listed:
            uses[w] = uses.get(w, 0) | use
    made = ahocorasick.Automaton()
    for w, use in uses.items():
        if w:
            made.add_word(w, (len(w), use))
    made.make_automaton()
    return made


class Words:
    """The listed words of a text: ``(start, stop)`` of those in context, known parts and telephone words."""

    def __init__(self, text: str, lexicon: Lexicon):
        self.text = text
        self.context: list[tuple[int, int]] = []
        self.known: list[tuple[int, int]] = []
        self.phone: list[int] = []
        low = fold(text)
        if len(low) == len(text):
            for last, (size, use) in _automaton(lexicon).iter(low):
                start, stop = last - size + 1, last + 1
                if (start == 0 or not low[start - 1].isalnum()) and (stop == len(low) or not low[stop].isalnum()):
                    self._put(start, stop, use)
        else:  # a letter whose lower case is longer moved the positions
            for m in LETTERS.finditer(text):
                self._put(*m.span(), _automaton(lexicon).get(fold(m.group()), (0, 0))[1])

    def _put(self, start: int, stop: int, use: int) -> None:
        if use & IN_CONTEXT:
            self.context.append((start, stop))
        if use & KNOWN and (word := WORD.match(self.text, start)) and word.end() == stop:
            self.known.append((start, stop))
        if use & TELEPHONE:
            self.phone.append(start)

    def starts_before(self, at: int, n: int = 4) -> list[int]:
        """Where up to ``n`` words before ``at`` begin, no more than ``LONGEST_NAME`` characters before it; the earliest first."""
        begin = max(0, at - LONGEST_NAME)
        found = [m.start() for m in WORD.finditer(self.text, begin, at)]
        return [x for x in found if x > begin or x == 0 or not self.text[x - 1].isalnum()][-n:]


def _context_names(words: Words, lexicon: Lexicon) -> Iterator[tuple[int, int, float]]:
    """Names that stand where their context points, with their scores, from the threshold on."""
    text, afters = words.text, []
    for start, stop in words.context:
        w = text[start:stop].lower()
        if w in AFTER_WORDS:
            afters.append(start - AFTER_WORDS[w])
        if not (kind := CUE.get(w)) or not (gap := GAP[kind].match(text, stop)):
            continue
        at = gap.end()
        while at < len(text) and (text[at].isupper() or kind in ("close", "title")) and (name := NAME_AT.match(text, at)):
            a, b = name.span()
            alone = kind == "close" and (b == len(text) or text[b : b + 2].lstrip(" ")[:1] == "\n")
            score = name_score(text, a, b, WEIGHT[kind] + 0.35 * (alone and not text[a].isupper()), lexicon)
            if score < THRESHOLD:
                break
            yield a, b, score
            after = NEXT.match(text, b)
            at = after.end() if after else len(text)
    at = text.find(" (")
    while at >= 0:
        afters.append(at)
        at = text.find(" (", at + 1)
    for at in afters:
        if at > 0 and text[at - 1].isalpha() and AFTER.match(text, at):
            for start in words.starts_before(at, 3):
                if (start == 0 or text[start - 1] not in "@-_.") and (m := NAME_AT.match(text, start)) and m.end() == at and (score := name_score(text, start, at, 0.0, lexicon)) >= THRESHOLD:
                    yield start, at, score
                    break


def _context_names_ar(text: str, lexicon: Lexicon) -> Iterator[tuple[int, int, float]]:
    for m in BEFORE_AR.finditer(text):
        if not (name := NAME_AR_AT.match(text, m.end())):
            continue
        a, b = name.span()
        after = NEXT_AR.match(text, b)
        second = NAME_AR_AT.match(text, after.end()) if after else None
        two = second and name_score_ar(text, *second.span(), 0.4, lexicon) >= THRESHOLD and name_score_ar(text, a, b, 0.4, lexicon) >= THRESHOLD
        score = name_score_ar(text, a, b, WEIGHT_AR[m.lastgroup] + 0.2 * bool(two), lexicon)
        if score >= THRESHOLD:
            yield a, b, score
            if two:
                yield *second.span(), score


def context_names(words: Words, lexicon: Lexicon) -> Iterator[tuple[int, int, float]]:
    yield from _context_names(words, lexicon)
    if ARABIC.search(words.text):
        yield from _context_names_ar(words.text, lexicon)


def _names(words: Words, lexicon: Lexicon) -> Iterator[Span]:
    text = words.text
    seen: list[tuple[int, int]] = []
    for a, b, score in context_names(words, lexicon):
        seen.append((a, b))
        yield Span(a, b, "name", min(score, 0.9))
    for first, stop in words.known:  # any other place that holds a known part
        if any(a <= first < b for a, b in seen):
            continue
        arabic = ARABIC.match(text, first)
        for at in [*words.starts_before(first), first]:
            if at and text[at - 1] in "@-_":
                continue
            best = (0.0, 0)
            for pattern in (NAME_AR_AT,) if arabic else (NAME_AT, THREE):
                m = pattern.match(text, at, stop + LONGEST_NAME)
                if m and m.end() >= stop and (pattern is not THREE or _three(m.group(), lexicon)):
                    best = max(best, ((name_score_ar if arabic else name_score)(text, *m.span(), 0.0, lexicon), m.end()))
            if best[0] >= THRESHOLD:
                seen.append((at, best[1]))
                yield Span(at, best[1], "name", max(THRESHOLD, best[0] - 0.01))
                break


def _three(name: str, lexicon: Lexicon) -> bool:
    """Whether the first and the last of three parts are known, and the one between is capitalised and no family name."""
    first, middle, *rest = name.split(" ", 2)
    return bool(rest) and first[0].isupper() and middle[0].isupper() and fold(first) in lexicon.given and split_name(f"{first} {rest[0]}")[1] in lexicon.family and fold(middle) not in lexicon.family


def spans(text: str, lexicon: Lexicon) -> list[Span]:
    """Non-overlapping spans of ``text`` (in consistent form), in order."""
    words = Words(text, lexicon)
    found = [*_emails(text)]
    starts = number_starts(text)
    found += _numbers(text, starts, words.phone)
    found += _addresses(text, starts, lexicon.towns)
    found += _names(words, lexicon)
    taken: list[Span] = []
    for s in sorted((s for s in found if s.score >= THRESHOLD), key=lambda s: (-s.score, s.start - s.end, s.start)):
        if not any(s.start < t.end and t.start < s.end for t in taken):
            taken.append(s)
    return sorted(taken)


def original_spans(texts: list[str], lexicon: Lexicon, odd_ones: list[bool] | None = None, alikes: Alikes = ()) -> list[list[Span]]:
    """Spans of each text as it stands. ``odd_ones`` false: the text is known to be in consistent form."""
    out: list[list[Span]] = [[] for _ in texts]
    odd = [i for i in range(len(texts)) if odd_ones is None or odd_ones[i]]
    if len(odd) < len(texts):
        for i in {*range(len(texts))} - {*odd}:
            out[i] = spans(texts[i], lexicon)
    for a, b in pieces([texts[i] for i in odd]):
        part = odd[a:b]
        exploded = consistent_batch([texts[i] for i in part], alikes)
        for i, form, source in zip(part, exploded.rebuilt(), exploded.sources(), strict=True):
            found = spans(form, lexicon)
            if form != texts[i]:
                found = [Span(int(source[s.start]), int(source[s.end - 1]) + 1, s.kind, s.score) for s in found]
            out[i] = found
    return out


def _forms(texts: list[str], odd_ones: list[bool], alikes: Alikes) -> list[str]:
    odd = [i for i, s in enumerate(odd_ones) if s]
    made = [*texts]
    for a, b in pieces([texts[i] for i in odd]):
        for i, form in zip(odd[a:b], consistent_batch([texts[i] for i in odd[a:b]], alikes).rebuilt(), strict=True):
            made[i] = form
    return made


_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("found", pa.string())])
_MASKED_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_found", pa.int32())])
_PARTS_ARROW = pa.schema([("kind", pa.string()), ("part", pa.string()), ("doc_id", pa.int64())])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(suspect(F.col("text")), F.lit(False)).alias("suspect"))


def _read_parts(batches: Iterator[pa.RecordBatch], alikes: Alikes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, parts, docs = [], [], []
        for doc, text in zip(batch["doc_id"].to_pylist(), _forms(batch["text"].to_pylist(), batch["suspect"].to_pylist(), alikes), strict=True):
            own = set()
            for a, b, _ in context_names(Words(text, NOTHING), NOTHING):
                given, family = split_name(text[a:b])
                own |= {("given", given), ("family", family)}
            for m in _address_matches(text, number_starts(text)):
                town_end, end = _town_end(text, m, frozenset())
                if end > town_end:
                    own.add(("town", fold(text[m.start("town") : town_end])))
            for kind, part in own:
                if len(part) > 1:
                    kinds.append(kind)
                    parts.append(part)
                    docs.append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(parts, pa.string()), pa.array(docs, pa.int64())], schema=_PARTS_ARROW)


#: What a part of a name can be cut from, and a family name's particle that stands as a word of its own.
RUN = re.compile(r"[\w'’ً-ْ-]+")
PARTICLE_BEFORE = re.compile(r"(?<!\w)(?:al|el|van|de|bin|ibn)[ ]$", re.I)


def lookups(text: str) -> set[tuple[bool, str]]:
    """``(town, part)``: whatever ``spans`` may look up for ``text`` (in consistent form), and more."""
    low = text.lower().replace("’", "'")
    made: set[tuple[bool, str]] = set()
    for run in RUN.finditer(text):
        a, b = run.span()
        starts = [i for i in range(a, b) if text[i].isalnum() and (i == a or not text[i - 1].isalnum())]
        ends = [i for i in range(a + 1, b + 1) if i == b or not text[i].isalnum()]
        for start in starts:
            particle = PARTICLE_BEFORE.search(text, max(0, start - 5), start)
            for end in ends:
                if end > start + 1:
                    part = fold(text[start:end])
                    made.add((False, part))
                    if len(low) == len(text):
                        made.add((False, low[start:end]))
                    if particle:
                        made.add((False, f"{fold(particle.group()[:-1])} {part}"))
    for m in _address_matches(text, number_starts(text)):
        at = m.start("town")
        words = [*re.finditer(r"[^\W\d_][\w'’-]*", text[at : m.end("town")])]
        for k in range(1, len(words) + 1):
            made |= {(True, " ".join(fold(w.group()) for w in words[:k])), (True, fold(text[at : at + words[k - 1].end()]))}
    return made


_LOOKUPS_ARROW = pa.schema([("key", pa.int64()), ("town", pa.bool_()), ("part", pa.string())])


def _read_lookups(batches: Iterator[pa.RecordBatch], alikes: Alikes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch["key"].to_pylist(), _forms(batch["text"].to_pylist(), batch["suspect"].to_pylist(), alikes), strict=True):
            made = [*lookups(text)]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(made), pa.int64()), pa.array([t for t, _ in made], pa.bool_()), pa.array([x for _, x in made], pa.string())], schema=_LOOKUPS_ARROW)


def of_parts(parts: list[tuple[str, str]]) -> Lexicon:
    return Lexicon(*(frozenset(part for kind, part in parts if kind == k) for k in ("given", "family", "town")))


def learn_parts(docs: DataFrame, person_names: DataFrame) -> DataFrame:
    """``(kind, part)``: all name parts and towns that two different documents hold at least, and the given list.

    A part's least and greatest document tell whether there are two, however often a document was sent: both are
    pre-aggregated, nothing is made distinct.
    """
    read = _texts(docs).where("text is not null").mapInArrow(partial(_read_parts, alikes=confusables(docs.sparkSession)), "kind string, part string, doc_id bigint")
    counted = read.groupBy("kind", "part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    listed = person_names.where("name_part is not null").select("kind", F.lower("name_part").alias("part"))
    return cut_lineage(counted.select("kind", "part").unionAll(listed).distinct())


def with_lexicon(docs: DataFrame, person_names: DataFrame) -> tuple[DataFrame, Lexicon | None]:
    """The texts, and the lexicon to replicate. Beyond ``MAX_LEXICON`` parts none: each text then brings its ``own`` parts.

    Those are joined on what the text may look up. Texts of one key share their parts, which adds known parts only.
    """
    parts = learn_parts(docs, person_names)
    rows = parts.limit(MAX_LEXICON + 1).collect()
    if len(rows) <= MAX_LEXICON:
        return _texts(docs), of_parts([(r["kind"], r["part"]) for r in rows])
    texts = _texts(docs).withColumn("key", F.xxhash64("text"))
    asked = texts.where("text is not null").select("key", "text", "suspect").mapInArrow(partial(_read_lookups, alikes=confusables(docs.sparkSession)), "key bigint, town boolean, part string").distinct()
    known = asked.join(parts.withColumn("town", F.col("kind") == "town"), ["town", "part"])
    own = known.groupBy("key").agg(F.collect_list(F.struct("kind", "part")).alias("own"))  # at most the words of a text
    return texts.join(own, "key", "left").select("doc_id", "text", "suspect", "own"), None


def _batch_spans(batch: pa.RecordBatch, lexicon: Lexicon | None, alikes: Alikes) -> list[list[Span]]:
    texts, odd = [t or "" for t in batch["text"].to_pylist()], batch["suspect"].to_pylist()
    if lexicon is not None:
        return original_spans(texts, lexicon, odd, alikes)
    own = [of_parts([(x["kind"], x["part"]) for x in parts or []]) for parts in batch["own"].to_pylist()]
    return [original_spans([t], x, [o], alikes)[0] for t, x, o in zip(texts, own, odd, strict=True)]


def find(docs: DataFrame, person_names: DataFrame) -> DataFrame:
    """``(doc_id, kind, found)``, one row per document, kind and distinct string as it stands in the text."""
    rows, lexicon = with_lexicon(docs, person_names)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, confusables(docs.sparkSession)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            strings = set()
            for doc, text, found in zip(batch["doc_id"].to_pylist(), texts, _batch_spans(batch, *shared.value), strict=True):
                strings |= {(doc, s.kind, text[s.start : s.end]) for s in found}
            columns = list(zip(*strings, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

    return rows.where("text is not null").mapInArrow(search, "doc_id bigint, kind string, found string").distinct()


def masked(docs: DataFrame, person_names: DataFrame) -> DataFrame:
    """``(doc_id, text, n_found)``: every row's text with placeholders in place of what was found, all else unchanged."""
    rows, lexicon = with_lexicon(docs, person_names)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, confusables(docs.sparkSession)))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            out, counts = [], []
            for text, found in zip(texts, _batch_spans(batch, *shared.value), strict=True):
                pieces, at = [], 0
                for s in found:
                    pieces += [text[at : s.start], PLACEHOLDER[s.kind]]
                    at = s.end
                out.append(None if text is None else "".join([*pieces, text[at:]]))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string()), pa.array(counts, pa.int32())], schema=_MASKED_ARROW)

    return rows.mapInArrow(mask, "doc_id bigint, text string, n_found int")
