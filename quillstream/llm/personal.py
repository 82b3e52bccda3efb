"""Problem 6: personal information inside free text.

Method: weak supervision. Regular expressions propose spans; labelers (patterns, a gazetteer of given names,
the words before and after, checksums) vote for, against or not at all. The votes of all spans of all rows
are counted by pattern, expectation-maximisation over these counts estimates how reliable each labeler is,
and the posterior labels train the final span classifier, a logistic regression over the votes and their pairs.
There are at most 3^labelers patterns a kind whatever the number of rows, so only the counts reach the driver.

Card numbers must have a valid check digit; that exact check follows the classifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.text_form import consistent_col, origins
from quillstream.session import cut

KINDS = ("email", "phone", "id_number", "card", "address", "person")
LABELERS = 6

# Given names with common short forms.
GIVEN = frozenset(
    """Adam Adele Agnieszka Ahmed Alan Alejandro Alex Alexander Alexandra Alexei Alice Alina Amara Amelia Ana Andre André Andrea Andrew Andrzej
    Anita Anna Anne Antonio Arthur Barbara Beatriz Ben Benjamin Benny Bernard Bernd Bill Björn Bob Boris Brian Bruno Camille Carla Carlos Carmen
    Carol Caroline Cathy Charles Charlotte Chen Chloe Chloé Chris Christian Christine Christopher Claire Clara Claudia Clare Colin Daniel Dan Daniela Dara
    David Diana Diego Dima Dimitri Dmitri Dmitry Dorothy Dre Dré Edward Ekaterina Elena Eleanor Elisa Elizabeth Ella Ellen Emil Emily Emma Eric Erik Eva
    Fatima Felix Fernando Filo Fiona Florian Francesca Francisco Frank Fred Freda Friedrich Fritz Gabriel Gabriela George Georg Giovanni Greg Gregory Gustav Hannah Hans
    Harry Heinrich Helen Helena Henri Henry Hiro Hugo Igor Ines Inga Irina Isabel Isabella Isaac Ivan Jack Jacob James Jan Jane Janet Jean Jens Jennifer Jessica
    Joan Joanna João Joe Johann Johannes John Jonas José Jose Joseph Juan Julia Julian Juliette Karen Karl Kate Katharina Katherine Kathy Katie Katja Kenji Kevin
    Klaus Kofi Kristina Lars Larry Laura Lawrence Leila Lena Leo Leon Leonard Li Liam Lisa Liz Lorenzo Louis Louise Luca Lucas Lucia Lucy Luis Lukas Maciej
    Magdalena Mara Marc Marco Margaret Maria Marie Mario Mark Marl Marta Martha Martin Mateo Matteo Matthew Maya Meg Mei Michael Michel Mick Miguel Mike Milo Mohammed
    Monika Nadia Naomi Natalia Nate Nathan Nathaniel Nell Nick Nicolas Nicole Nina Nora Oksana Ola Oleg Olga Oliver Olivia Omar Otto Pablo Pam Pamela Patricia Patty
    Paul Paula Pedro Penny Pepe Peter Petra Philip Pierre Piotr Rachel Rafael Ralf Rebecca Rena Richard Rita Rob Robert Roberto Roger Rosa Rosie Ruth Sam Samantha
    Samuel Sandra Sara Sarah Sasha Sebastian Sergei Sofia Sonia Søren Soren Stefan Stella Stephen Steve Sue Susan Susanna Susie Sven Tanya Tatiana Ted Teodora Teresa
    Theo Theodora Thomas Tim Tina Tom Tomasz Tony Ulrich Ursula Valentina Vera Victor Victoria Viktor Vincent Vicky Wei Wilhelm Will William Winifred Winnie Wolfgang
    Xavier Yan Yana Yolanda Yuki Yusuf Zara Zoe Zoë Zo Zofia""".split()
)
TITLES = r"(?:Dr|Prof|Mrs|Mr|Ms|Miss|Mme|Mlle|M|Herr|Frau|Sr|Sra|Señora?|Don|Doña|Pani?|Sir|Dame|Rev|Fr|Coach|Captain|Signora?|Dott)\.?"
_CAP = r"[A-ZÀ-ÞŁŚŻŹĆ][\w’'-]*[a-zà-ÿłśżźćńęą]"
_NAME = rf"(?:{_CAP}(?:-{_CAP})?|[A-ZÀ-Þ]{{3,}}(?:-[A-ZÀ-Þ]{{3,}})?)"
_GIVEN_ANY = "(?:" + "|".join(sorted((re.escape(g) for g in GIVEN), key=len, reverse=True)) + ")"
_G = rf"(?:{_GIVEN_ANY}|{'|'.join(sorted((re.escape(g.upper()) for g in GIVEN if len(g) > 2), key=len, reverse=True))})"
_PERSON = re.compile(
    rf"\b{TITLES}\s+(?:[A-ZÀ-Þ]\.\s*){{0,2}}(?:{_G}\s+(?:[A-ZÀ-Þ]\.\s*)?)?{_NAME}"
    rf"|\b{_G}(?:[ -]{_G})?\s+(?:[A-ZÀ-Þ]\.?\s+)?(?:(?:van|von|de|da|del|di|la|le|bin|al)\s+)?{_NAME}"
    rf"|\b{_NAME},\s+{_G}\b(?:\s+[A-ZÀ-Þ]\.)?"
    rf"|\b{_NAME}\s+{_G}\b"
    rf"|\b{_NAME},\s+[A-ZÀ-Þ]\.(?=\W|$)"
    rf"|\b(?:[A-ZÀ-Þ]\.\s*){{1,2}}{_NAME}"
)
_LOWER = re.compile(r"\b(" + "|".join(sorted((re.escape(g.lower()) for g in GIVEN if len(g) > 2), key=len, reverse=True)) + r")\s+(?:[a-z]\.?\s+)?([a-zà-ÿ]{4,}(?:-[a-zà-ÿ]{4,})?)\b")
_LOWER_TITLE = re.compile(r"\b(?:dr|prof|mrs|mr|ms|mme|herr|frau)\.?\s+(?:[a-z]\.\s*)?([a-zà-ÿ]{5,})\b")
# Words that stand before or after persons, places and organisations.
_ORG = re.compile(r"\s*(?:Network|Trust|Guild|Works|Council|Bureau|Archive|Circle|University|Institute|Company|Corporation|Department|Laborator\w+|Society|Club|Association|Foundation|Bank|Street|Road|Lane|Avenue|Square|Court|Row|Drive)\b")
_PLACE = re.compile(r"(?:New|Port|Upper|Bad|Lake|Lower|Old|Saint|San|Mount|North|South|East|West)$")
_PERSON_LEFT = re.compile(r"(?i)(?:regards to|love to|thanks to|hello to|greetings (?:to|from)|ask|met|saw|know|knows|call|called|tell|told|invited?|signed|written|said|by|with|for|from|and|author|contact|owner|pregunta a|pergunta a|gracias a|zapytaj|frag|danke an|demandez à|merci à|спросите|borrowed from|belongs to|kept by|[:–—])[:,]?\s*$")
_PERSON_RIGHT = re.compile(r"(?i)\s*(?:['’]s\b|[,–—-]?\s*(?:and|or|who|is|was|has|had|will|would|can|says?|said|told|asked|wrote|called|lives?|works?|knows?|next|of all|before|still|small|tiene|es|está|et|on|est|hat|ist|von|und|ma|jest|i\b|tem|é\b|ключ|и\b)|\((?:she|he|they)\b)")
_PHONE_LEFT = re.compile(r"(?i)(?:\btel\b\.?|phone|call(?: me)?(?: on| from)?|ring|whatsapp|fax|mobile|cell|text me(?: on| at)?|number (?:on the note )?(?:was|is)|dial|звоните|ruf an|rufnummer|llama al|appelle[rz]?|telefon\w*|tél\.?|hotline|sms)\W*(?:on|at|from|:|to|unter|au|al|pod|por)?\W*$")
_DECOY_LEFT = re.compile(r"(?i)(?:\border|build|invoice(?: no\.?)?|parcel|isbn|version|label|map|shelf|signature|form(?: no\.?)?|voucher|room|coins|edition|chapter|ticket|serial(?: no\.?)?|bestellung|tracking(?: no\.?)?|batch|lot|article|artikel|part no\.?|model|doi|ref(?:erence)?(?: no\.?)?|score|coordinates|people|code|steps|page|flight|platform)\W*$")
_DECOY_RIGHT = re.compile(r"(?i)\s*(?:steps|people|chairs|coins|euro|eur|usd|%|km|kg|m\b|pages|copies|answers with|°|views)")
_ID_WORD = re.compile(r"(?i)(?:passports?|reisepass|pasaporte|passeport|passaporte|paszport\w*|паспорт\w*|national id(?:entity)?(?: card)?|identity (?:card|number)|id card|social security|social insurance|national insurance|ssn|nino|ni number|tax (?:id|number|payer)|steuer-?id|steuernummer|driv(?:ing|er'?s?) licen[cs]e|führerschein\w*|permis de conduire|dni|nie|nif|pesel|nip|cpf|ausweis(?:nummer|nr)?|personalausweis\w*|insee|codice fiscale|инн|снилс)(?:\s*(?:no\.?|number|nr\.?|num\.?|n[º°]|#|card|номер))?\W*$")
_PAY_LEFT = re.compile(r"(?i)(?:charged?(?: it)? to|pa(?:id|y) (?:with|by)|use|refund(?: went)?(?: to)?|receipt(?: \w+){0,2}|photo|card(?: number| no\.?)?|credit|debit|payé avec|payer par|bezahlt mit|se pagó con|pagado con|оплат\w+ (?:с|картой)|zapłac\w*(?: kartą)?|paguei com|pago com|visa|mastercard|amex)\W*$")
_ADDRESS_LEFT = re.compile(r"(?i)(?:(?:key|flat|house|door|shop|office|party|meeting)(?: is)? at|flat is|mov(?:ed|ing) (?:from|to)|lives? (?:at|in|on)|deliver(?:ed|y)? to|meet(?: me| us)? at|visit(?: us)? at|(?:parcels?|letters?|post|mail|packages?) (?:go(?:es)?|to)(?: to)?|address(?: is| was)?|vivimos en|vivo en|calle|colis vont au|habit\w+(?: au)?|живём(?: здесь)?|адрес|wohn\w+(?: jetzt)?(?: in)?|mieszkam\w*(?: przy)?|mor\w+ (?:na|em|no)|send (?:it )?to|at)\W*$")
_EMAIL_LEFT = re.compile(r"(?i)(?:mail|e-mail|email|write to|contact|address was|goes to|send it to|escribe a|schreib an|écris à|пишите на|napisz na|escreve para|reach me)\W*(?:<|mailto:)?\s*$")
_AT = re.compile(r"(?i)\s*[\[({]\s*at\s*[\])}]\s*|\s?@\s?|\s+at\s+")
_LOCAL = re.compile(r"[\w+-]+(?:(?:\.|\s+(?:dot|DOT)\s+|\s*[\[(]dot[\])]\s*)[\w+-]+)*$")
_HOST = re.compile(r"(?i)[\w-]+(?:(?:\.|\s+dot\s+|\s*[\[(]dot[\])]\s*)[\w-]+)+")
_FIVE_DIGITS = re.compile(r"\d(?:[^\d\n]{0,2}\d){4}")


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, sign between the parts) of addresses, plain or spelled to mislead machines."""
    for m in _AT.finditer(text):
        word = m[0].strip().lower() == "at"
        if word and " dot " not in text.lower():
            continue
        reach = 90
        while (local := _LOCAL.search(text, max(0, m.start() - reach), m.start())) and 0 < m.start() - reach == local.start():
            reach *= 2  # a longer local part begins before
        host = _HOST.match(text, m.end())
        if local and host and (not word or re.search(r"(?i)\bdot\b", host[0])):
            yield m.start() - len(local[0]), host.end(), m[0].strip()


_NUMBER = re.compile(r"(?<![\w.,/@#-])\+?\(?\d(?:[ ()./\u2010-\u2013-]{0,2}\d){6,24}(?![\w])")
_ID = re.compile(r"(?<![\w/@.])(?:[A-Z]{1,3}[ -]?)?\d(?:[ /.-]?[A-Z0-9]){4,17}(?![\w])|(?<![\w/@.])[A-Z]{2,3}(?: ?\d\d){3} ?[A-Z](?!\w)|(?<![\w/@.])[A-Z]{2} \d{3} \d{4}(?!\w)|(?<![\w/@.])[A-Z](?=[A-Z0-9]*\d{3})[A-Z0-9]{7,9}(?!\w)")
_ID_SHAPE = re.compile(r"\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{8}-?[A-Z]|\d{6}-\d{4}|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{2} \d{3} \d{4}|\d{2}-\d{7}|\d{3} \d{2} \d{4}|[A-Z]\d{2}[A-Z]\d{5}|[A-Z]\d{7,8}")
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Drive|Dr\.?|Court|Ct\.?|Square|Sq\.?|Row|Close|Way|Terrace|Place|Pl\.?|Crescent|Hill|Gardens?|Boulevard|Blvd\.?|Quay|Walk|Parade|Mews|Grove|\w+walk)"
_W = r"[A-ZÀ-Þ][\w.’'-]*"
_ADDRESS = re.compile(
    rf"\b\d{{1,4}}[a-zA-Z]?,?\s+(?:{_W}\s+){{0,3}}{_STREET}(?!\w)"
    rf"|\b\d{{1,4}}\s?(?:bis|ter)?,?\s+(?:rue|avenue|boulevard|chemin|place|impasse|allée|quai)\s+(?:des?\s+|du\s+|d['’]|de\s+l[a'’]\s*)?{_W}"
    rf"|\b(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Rua|Travessa|Largo|Praça|Via|Viale|Piazza|Corso)\s+(?:(?:del|de|de la|das|dos|da|do|della)\s+)?{_W}(?:\s+{_W})?,?\s+(?:n[º°.]\s*)?\d{{1,4}}"
    rf"|\b(?:ul|al|os|pl)\.\s*{_W}(?:\s+{_W})?\s+\d{{1,4}}(?:/\d+)?"
    rf"|\b{_W}(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring)\s+\d{{1,4}}\s?[a-z]?\b"
    rf"|\b(?:Am|An der|Im|Auf dem|Zum|Zur)\s+{_W}(?:\s+{_W})?\s+\d{{1,4}}\s?[a-z]?\b"
    rf"|\b(?:ул\.|улица|пр\.|проспект|пер\.)\s*[А-ЯЁ][\w-]*,?\s+(?:д\.\s*)?\d{{1,4}}"
)
_ADDRESS_LOWER = re.compile(r"\b\d{1,4}[a-z]?,?\s+(?:[a-z.]+\s+){0,3}(?:street|road|lane|avenue|drive|court|square|row|ropewalk)\b|\b(?:calle|rua|ul\.)\s+(?:(?:del|das|de)\s+)?[a-z]+\s+\d{1,4}|\b[a-z]{4,}(?:straße|gasse)\s+\d{1,4}\b|\b\d{1,4}\s+rue\s+des?\s+[a-z]+|\bam alten markt \d+")
_URL = re.compile(r"(?i)\b(?:https?://|www\.)\S+")
_DIGIT = re.compile(r"\d")
_TOKEN = re.compile(r"[A-ZÀ-Þ][\w’'-]*\.?")
_LOW_TOKEN = re.compile(r"[a-zà-ÿ]{2,}")
_TITLE_WORD = re.compile(TITLES + "$")
_GIVEN_LOW = frozenset(g.lower() for g in GIVEN if len(g) > 2)
_GIVEN_UP = frozenset(g.upper() for g in GIVEN if len(g) > 2)
_TITLE_LOW = frozenset("dr prof mrs mr ms mme herr frau".split())


def _persons(text: str) -> Iterator[re.Match]:
    """Matches of `_PERSON`, tried only near a given name, a title or an initial."""
    end = 0
    starts = [(m.start(), m[0]) for m in _TOKEN.finditer(text)]
    for k, (i, t) in enumerate(starts):
        if i < end:
            continue
        bare = t.rstrip(".")
        for part in bare.split("-") if "-" in bare else (bare,):
            if part in GIVEN or part in _GIVEN_UP or len(bare) == 1 and (t[-1] == "." or k and starts[k - 1][1] in GIVEN) or _TITLE_WORD.match(t):
                lo = starts[k - 1][0] if k and i - starts[k - 1][0] < 40 and starts[k - 1][0] >= end else i
                m = _PERSON.match(text, i)
                if lo != i and (not m or text[i - 2 : i] == ", "):
                    m = _PERSON.match(text, lo) or m
                if m and m.end() > i:
                    end = m.end()
                    yield m
                break


def luhn(digits: str) -> bool:
    """Is the last digit the check digit of the others?"""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _vote(*votes: int) -> str:
    """Votes for (+), against (-) and none (0), padded to `LABELERS`."""
    return "".join("-0+"[v + 1] for v in votes).ljust(LABELERS, "0")


_CAPITALS = re.compile(r"[A-Z]{2,3}[ -]")


def _pieces(m: re.Match) -> Iterator[tuple[int, str]]:
    """A number, and where it starts; the end of a sentence parts two numbers."""
    at = m.start()
    for part in re.split(r"(\.\s+)", m[0]):
        if sum(c.isdigit() for c in part) >= 7:
            yield at, part
        at += len(part)


def spans(text: str) -> list[tuple[str, int, int, str]]:
    """Proposed spans (kind, start, end, votes) of a text in the consistent form."""
    out: list[tuple[str, int, int, str]] = []
    urls = [m.span() for m in _URL.finditer(text)] if "http" in text or "www." in text or "HTTP" in text else []
    in_url = lambda i: any(a <= i < b for a, b in urls)
    lower = not any(c.isupper() for c in text)
    emails = []
    for i, j, sign in _emails(text):
        left, s = text[max(0, i - 40) : i], text[i:j]
        spelled = sign != "@" or bool(re.search(r"(?i)\bdot\b", s))
        path = left.endswith("/") or in_url(i) or left.endswith(":") and not left.lower().endswith("mailto:") and not left.endswith(": ")
        out.append(("email", i, j, _vote(1 if sign == "@" else 0, 1 if spelled else 0, 1 if _EMAIL_LEFT.search(left) else 0, -1 if path else 0, 1 if re.search(r"[A-Za-z]{2,}$", s) else -1)))
        emails.append((i, j))
    if _FIVE_DIGITS.search(text):
        for start, s in (x for m in _NUMBER.finditer(text) for x in _pieces(m)):
            end = start + len(s)
            if in_url(start):
                continue
            left, right = text[max(0, start - 40) : start], text[end : end + 20]
            if s[0] == "(" and ")" not in s:
                s = s[1:]
            d = re.sub(r"\D", "", s)
            decoy = bool(_DECOY_LEFT.search(left) or _DECOY_RIGHT.match(right))
            idword = bool(_ID_WORD.search(left))
            if 13 <= len(d) <= 19 and not re.search(r"[()/+]|\.\d", s):
                book = d[:3] in ("978", "979") and len(d) == 13
                out.append(("card", start, end, _vote(1 if luhn(d) else -1, 1 if _PAY_LEFT.search(left) else 0, -1 if decoy or book else 0, 1 if d[0] in "345689" or d[:2] in ("22", "27") else -1, 1 if len(d) in (15, 16) else 0, -1 if idword else 0)))
            if 8 <= len(d) <= 15:
                dated = bool(re.fullmatch(r"(?:19|20)\d\d[.-]\d{1,2}[.-]\d{1,2}(?:[.-]\d+)?|\d{1,3}(?:\.\d{1,3}){3}|\d{1,3}(?:[ .]\d{3})+|(?:19|20)\d\d[- ]\d{4}|\d{1,3}\.\d{3,6}", s)) and not re.match(r"0\d{2} \d{3} \d{3}", s)
                strict = bool(re.match(r"\+\d|\(0\)\d|\(\d{2,5}\)|00\d", s) or re.fullmatch(r"0\d{1,4}[/ .-].*", s) or re.fullmatch(r"0\d{8,11}", s) or re.fullmatch(r"1?[ .-]?\d{3}[ .-]?\d{3}[ .-]\d{4}", s) or re.fullmatch(r"1\d{10}", s))
                ident = idword or bool(_ID_SHAPE.fullmatch(s)) and not strict
                card = 13 <= len(d) and luhn(d) and s[0] != "+"
                if idword or ident and not _PHONE_LEFT.search(left):
                    continue
                out.append(("phone", start, end, _vote(1 if strict else 0, 1 if _PHONE_LEFT.search(left) else 0, -1 if decoy else 0, -1 if dated else 0, -1 if ident or card else 0, 1 if 9 <= len(d) <= 13 else -1)))
        up = text.upper() if lower else text
        for m in _ID.finditer(up):
            if in_url(m.start()):
                continue
            start, s = m.start(), m[0]
            # a name of the number in capitals is no part of it
            if (named := _CAPITALS.match(s)) and _ID_WORD.search(text[max(0, start - 40) : start] + named[0]):
                start, s = start + named.end(), s[named.end() :]
            left = text[max(0, start - 40) : start]
            if sum(c.isdigit() for c in s) < 5:
                continue
            word = bool(_ID_WORD.search(left))
            shape = bool(_ID_SHAPE.fullmatch(s))
            if not word and not shape:
                continue
            strong = bool(re.fullmatch(r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{3}-\d{2}-\d{4}|\d{8}-[A-Z]|[A-Z]\d{3}-\d{4}-\d{4}", s))
            out.append(("id_number", start, m.end(), _vote(1 if word else 0, 1 if shape else 0, -1 if _DECOY_LEFT.search(left) and not word else 0, 1 if strong else 0, -1 if _PHONE_LEFT.search(left) else 0, -1 if not word and not strong else 0)))
    if _DIGIT.search(text):
        for m in (_ADDRESS_LOWER if lower else _ADDRESS).finditer(text):
            left, right = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 30]
            out.append(("address", m.start(), m.end(), _vote(1, 1 if _ADDRESS_LEFT.search(left) else 0, 1 if re.match(r"(?:,\s*\d\w*º|,? Apt|,\s*\d{4,5}\b|,\s*[A-ZÀ-Þ]| in [A-Z]| \d+\s*/)", right) else 0, -1 if re.search(r"(?i)(?:corner of|room|platform|floor|page|chapter|season|win|times)\W*$", left) else 0, -1 if re.match(r"(?i)\s*(?:times|people|points|minutes)", right) else 0)))
    inside = [*emails, *urls]
    for m in _persons(text):
        if any(a <= m.start() < b for a, b in inside) or text[m.start() - 1 : m.start()] in ("@", "/"):
            continue
        s, left, right = m[0], text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 24]
        tokens = re.findall(r"[\w’'-]+", s)
        given = any(t in GIVEN or t.title() in GIVEN and t.isupper() for t in tokens)
        title = bool(re.match(rf"{TITLES}\s", s)) and not (tokens[0] == "M" and "." not in s[:2])
        place = bool(_PLACE.search(tokens[0]) or _PLACE.search(left.rstrip()) or any(_PLACE.fullmatch(t) for t in tokens))
        rest = [t for t in tokens if t not in GIVEN and t.title() not in GIVEN]
        common = bool(rest) and all(t.lower() in _COMMON for t in rest)
        org = bool(_ORG.match(right)) or bool(_ORG.search(" " + s))
        out.append(("person", m.start(), m.end(), _vote(1 if given else 0, 1 if title else 0, 1 if _PERSON_LEFT.search(left) else 0, 1 if _PERSON_RIGHT.match(right) else 0, -1 if place or org else 0, -1 if common or not (given or title) else 0)))
    words = set(_LOW_TOKEN.findall(text))
    for p, names in ((_LOWER, _GIVEN_LOW), (_LOWER_TITLE, _TITLE_LOW)):
        if not names.isdisjoint(words):
            for m in p.finditer(text):
                if any(a <= m.start() < b for a, b in inside) or text[m.start() - 1 : m.start()] in ("@", "/", "+", ".", "_", "-"):
                    continue
                left, right = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 24]
                l, r = bool(_PERSON_LEFT.search(left)), bool(_PERSON_RIGHT.match(right))
                if not l and not r:
                    continue  # many given names are ordinary words in lower case
                out.append(("person", m.start(), m.end(), _vote(1 if p is _LOWER else 0, 1 if p is _LOWER_TITLE else 0, 1 if l else 0, 1 if r else 0, 0, -1 if not l and not r or m[m.lastindex] in _COMMON else 0)))
    return out


# Capitalised words that stand beside a given name without being a family name.
_COMMON = frozenset("the a an is was and or of on in at to for from with by said says not no yes if it its he she they we you i who why what when how new old port upper bad lake today between nobody honestly somebody reading never there this that these those my our your his her their january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday posts mail reply contact ask call".split())


def _fit(counts: pd.DataFrame) -> dict[tuple[str, str], float]:
    """Probability of each (kind, votes) from the counts of all spans.

    Expectation-maximisation with one reliability for each labeler and class, smoothed towards labelers that are
    right four times in five; then a logistic regression on votes and pairs of votes, trained on the posteriors.
    """
    out: dict[tuple[str, str], float] = {}
    for kind, part in counts.groupby("kind"):
        v = np.array([["-0+".index(c) for c in p] for p in part["votes"]])
        n = part["n"].to_numpy(float)
        prior = 0.5
        # rates[class, labeler, vote]
        rates = np.tile(np.array([[0.35, 0.45, 0.2], [0.05, 0.45, 0.5]])[:, None, :], (1, LABELERS, 1))
        strength = 0.5 * n.sum() + 10
        start = rates.copy()
        for _ in range(60):
            logs = np.array([sum(np.log(rates[c, j, v[:, j]]) for j in range(LABELERS)) for c in (0, 1)]) + np.log([[1 - prior], [prior]])
            post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
            for c, w in ((0, n * (1 - post)), (1, n * post)):
                for j in range(LABELERS):
                    seen = np.array([w[v[:, j] == x].sum() for x in range(3)])
                    rates[c, j] = (seen + strength * 0.2 * start[c, j]) / (seen.sum() + strength * 0.2)
            prior = float(np.clip((n @ post) / n.sum(), 0.05, 0.95))
        signed = v - 1.0
        x = np.concatenate([np.ones((len(v), 1)), (signed > 0), (signed < 0), *[(signed[:, [a]] * signed[:, [b]]) for a, b in combinations(range(LABELERS), 2)]], axis=1).astype(float)
        w = np.zeros(x.shape[1])
        for _ in range(40):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (n * (p - post)) + 0.05 * w
            h = (x * (n * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(len(w))
            w -= np.linalg.solve(h, g)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        out.update({(kind, s): float(q) for s, q in zip(part["votes"], p)})
    return out


def _span_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, t, *s) for k, t in zip(b["key"], b["text"]) if t for s in spans(t)]
        yield pd.DataFrame([(k, kind, i, j, v, t[i:j]) for k, t, kind, i, j, v in rows], columns=["key", "kind", "start", "end", "votes", "value"])


def found(df: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """Rows (key, kind, start, end, value) of the personal data in the texts, positions in the consistent form.

    Null, empty and blank texts give no row; texts are read whole; repeated rows are judged each under its
    own key; extra columns are dropped first; an empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 4)
    rows = rows.select("key", consistent_col(F.col("text")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    cand = cut(rows.mapInPandas(_span_batches, f"key {kind}, kind string, start int, end int, votes string, value string"))
    counts = cand.groupBy("kind", "votes").agg(F.count("*").alias("n")).toPandas()
    scores = _fit(counts)
    spark = df.sparkSession
    table = spark.createDataFrame([(k, v, p) for (k, v), p in scores.items()] or [("", "", 0.0)], "kind string, votes string, p double")
    good = cand.join(F.broadcast(table), ["kind", "votes"]).where("p >= 0.5")
    digits = F.regexp_replace("value", "[^0-9]", "")
    good = good.where((F.col("kind") != "card") | (F.call_function("luhn_check", digits)))
    return good.select(F.col("key").alias(key), "kind", "start", "end", "value", "p")


def redacted(df: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """Rows (key, redacted): every text with its personal data replaced by typed placeholders such as [EMAIL].

    Texts without personal data come out unchanged, null texts as null; beside the placeholders a text stays as it was
    written. Of overlapping spans the likelier
    and longer one counts.
    """
    hits = found(df, key, text).groupBy(key).agg(F.collect_list(F.struct("start", "end", "kind", "p")).alias("hits"))

    @F.pandas_udf("string")
    def replace(t: pd.Series, hits: pd.Series) -> pd.Series:
        def one(s, h):
            if s is None or h is None:
                return s
            taken: list[tuple[int, int, str]] = []
            for x in sorted(h, key=lambda x: (-round(x["p"], 3), x["start"] - x["end"])):
                if all(x["end"] <= a or x["start"] >= b for a, b, _ in taken):
                    taken.append((x["start"], x["end"], x["kind"]))
            at = origins(s)
            for a, b, k in sorted(taken, reverse=True):
                s = f"{s[:at[a]]}[{k.upper()}]{s[at[b]:]}"
            return s

        return pd.Series([one(s, h) for s, h in zip(t, hits)], dtype=object)

    rows = df.select(key, F.col(text).alias("text")).join(hits, key, "left")
    return rows.select(key, F.when(F.col("hits").isNull(), F.col("text")).otherwise(replace("text", "hits")).alias("redacted"))
