"""The small labelled table that the field for personal data learns from.

Lines in English, German, French and Spanish with places for values; each line
is filled several times from small rules with a fixed seed.  A place
``{kind}`` or ``{kind:form}`` is a value to find; ``{~form}`` is one to leave alone.
"""

from __future__ import annotations

import random
import re

#: How often each line is filled.
FILLS = 6

LINES = """
call me at {phone_local} after work
you can reach us on {phone_local}.
his number is {phone_local} at home
tel. {phone_local} or come by
Phone: {phone_local}, ask for the manager
her mobile ({phone_local}) was off all day
fax {phone_local} for the office
text {phone_local} when you arrive
Telefon {phone_local} (werktags)
ruf mich unter {phone_local} an
Tel.: {phone_local}
Sie erreichen uns unter der Nummer {phone_local}
meine Handynummer ist {phone_local}
appelez le {phone_local} avant midi
mon téléphone : {phone_local}
joignable au {phone_local} le soir
llámame al {phone_local} por la tarde
teléfono {phone_local}, preguntar por Ana
mi móvil es el {phone_local}
contact,{phone_local},open
the line {phone_local:bracket} is busy
we spoke on {phone_local:bracket} yesterday
ssn {national_id:us} on file
her social security number {national_id:us} was printed
SSN: {national_id:us}
the id {national_id:us} belongs to him
record;{national_id:us};active
his DNI is {national_id:es}
DNI {national_id:es} expedido en Madrid
con número de identidad {national_id:es}
Steuer-ID {national_id:de}
die Sozialversicherungsnummer {national_id:sv} steht im Bescheid
meine Steueridentifikationsnummer lautet {national_id:de}
numéro de sécurité sociale {national_id:fr}
NIR : {national_id:fr}
passport {document_id} was stolen
passport no. {document_id}, issued in 2015
her driver's license number is {document_id}
Reisepass Nr. {document_id}
Ausweisnummer: {document_id}
passeport {document_id} valable
carte d'identité n° {document_id}
pasaporte {document_id} caducado
date of birth: {birth_date}
born on {birth_date} in a small town
DOB {birth_date}
her birthday is {birth_date}
geboren am {birth_date} in Köln
Geburtsdatum: {birth_date}
née le {birth_date} à Lyon
date de naissance : {birth_date}
nacido el {birth_date} en Sevilla
fecha de nacimiento {birth_date}
pay to {iban} by Friday
IBAN: {iban}
account {iban} at the bank
überweisen Sie auf {iban}
Kontonummer {iban}
virement sur le compte {iban}
transferir a la cuenta {iban}
the password is {secret:word}
Password: {secret:word}
my pin is {secret:pin}
api key: {secret:key}
api_key={secret:key}
export SECRET_KEY={secret:key}
Authorization: Bearer {secret:key}
access key {secret:key} leaked
auth = "{secret:hex}" in the config
secret: {secret:hex} was read
client_secret: '{secret:hex}',
{"token": "{secret:key}"}
token {secret:hex} expired
Passwort: {secret:word}
das Kennwort lautet {secret:word}
mot de passe : {secret:word}
la clé secrète {secret:key}
contraseña: {secret:word}
la clave es {secret:word}
my name is {person} and i write code
dear Mr. {person}, thank you
Mrs {person} will see you now
Name: {person}
signed, Dr. {person}
ich heiße {person} und wohne hier
Sehr geehrter Herr {person}, vielen Dank
Frau {person} ist heute krank
je m'appelle {person} et je chante
Madame {person} est absente
nom : {person}
me llamo {person} y vivo aquí
el señor {person} no está
nombre: {person}
she lives at {address:en} with her dog
send it to {address:en}.
Address: {address:en}
er wohnt in der {address:de} im dritten Stock
Adresse: {address:de}
il habite {address:fr} depuis mars
adresse : {address:fr}
vive en la {address:es} desde mayo
dirección: {address:es}
in {~year} there were {~small} of them
chapter {~small} begins on page {~small}.
see section {~section} of version {~version}
from {~date} to {~date} it ran
the meeting on {~date} at {~time} was long
about {~big} people and {~small}% of all
the price was ${~price} or {~small} euros
order {~digits} was shipped
a number {~digits} without meaning
item {~digits} in the list
invoice no. {~digits} is due
room {~small}b on floor {~small} of {~small}
h2o and co2 in the x86 world
mp3 files since the 1990s
scores {~small}-{~small} and {~small}-{~small}
pages {~small}-{~small} and {~small}
{~small} {~small} {~small} {~small} {~small} {~small}
isbn 978-3-16-148410-0 was sold
the 1st, 2nd and 3rd of {~big}
words2345 with6 digits7 inside89 them
on port 8080 with {~big} users and 65536 slots
v{~version}-beta4 is out
commit {~short} fixed the build
sha256 sums are listed below
im Jahr {~year} waren es {~small}
Kapitel {~small}, Seite {~small}
am {~date} um {~time} Uhr
en {~year}, environ {~big} personnes
le {~date} à {~time}
en el año {~year} hubo {~small}
el {~date} a las {~time}
{~big} x {~big} pixels at {~small} fps
temperature fell to -{~small}.5 degrees
call {~small} functions before page {~small}
the phone cost {~price} in {~year}
the name of the rose
what is the name of this thing
the password must be long
the key to the house
a token of love
Schlüssel und Schloss
le mot juste
the token bucket algorithm
el nombre de la rosa
der Name der Rose
le nom de la rose
he was born in a small town
address the problem first
mr and mrs do not know
lives depend on it
a b c {~digits} d e f
{~section} {~section} and so on
the line {~digits} {~digits} {~digits}
on the way {~small} of us met {~digits} more
THE TIME HAS COME!! EVERYBODY!! GOES!! HOME!! AGAIN
WIR GEHEN!! JETZT!! ALLE!! NACH!! HAUSE
TOUT LE MONDE!! RENTRE!! MAINTENANT
TODOS!! A CASA!! AHORA!! VAMOS
it ended. So. They left. In. The. Ocean
they came from over there. And. Then. Caribbean
""".strip().split("\n")

FIRST = "Anna Peter Maria Jean Carlos Lukas Sophie Elena Marc Julia Thomas Camille Diego Hannah Oliver Claire Pablo Greta Emma Hugo".split()
LAST = "Smith Müller Dubois García Schneider Martin López Weber Johnson Lefèvre Fernández Fischer Brown Moreau Sánchez Wagner Taylor Girard Romero Becker".split()
STREETS = {
    "en": "Main Oak Baker Church Mill Station".split(),
    "de": "Haupt Garten Bahnhof Linden Schul Wald".split(),
    "fr": ["de la Paix", "Victor Hugo", "du Moulin", "des Lilas", "de l'Église"],
    "es": ["Mayor", "del Sol", "San Juan", "de la Luna", "Real"],
}
MONTHS = ["{d} May {y}", "{d} October {y}", "{d}. Mai {y}", "{d}. Dezember {y}", "{d} mai {y}", "{d} août {y}", "{d} de mayo de {y}", "{d} de enero de {y}", "May {d}, {y}"]
LETTERS, LOWER = "ABCDEFGHJKLMNPQRSTUVWXYZ", "abcdefghijkmnopqrstuvwxyz"


def _digits(r: random.Random, pattern: str) -> str:
    """The pattern with a digit for each #, a capital for each A."""
    return "".join(r.choice("0123456789") if c == "#" else r.choice(LETTERS) if c == "A" else c for c in pattern)


def iban(r: random.Random) -> str:
    """A well-formed account number, in groups of four or as one."""
    country, size = r.choice([("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18)])
    body = (_digits(r, "AAAA") if country == "GB" else "") + _digits(r, "#" * (size - 4 * (country == "GB")))
    rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    whole = f"{country}{98 - rest:02d}{body}"
    return whole if r.random() < 0.5 else " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))


def _date(r: random.Random, years: tuple[int, int]) -> str:
    d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(*years)
    return r.choice([f"{d:02d}/{m:02d}/{y}", f"{d:02d}.{m:02d}.{y}", f"{y}-{m:02d}-{d:02d}", f"{d}.{m}.{y}", r.choice(MONTHS).format(d=d, y=y)])


def _mixed(r: random.Random, n: int) -> str:
    return "".join(r.choice(LETTERS + LOWER + "0123456789" * 2) for _ in range(n))


def value(kind: str, r: random.Random) -> str:
    """A value of a kind or form."""
    small = r.randint
    phones = ["###-###-####", "###.###.####", "### ### ####", "0## ########", "0# ## ## ## ##", "0###/#######", "0###-#######", "## ### ## ##", "### ### ###", "##########", "0## ######", "0#.##.##.##.##", "###-####"]
    forms = {
        "phone_local": lambda: _digits(r, r.choice([*phones, "(###) ###-####", "(0##) ### ####"])),
        "bracket": lambda: _digits(r, r.choice(["(###) ###-####", "(0##) ### ####", "(###) ###.####"])),
        "us": lambda: _digits(r, "###-##-####"),
        "es": lambda: _digits(r, "########A"),
        "de": lambda: _digits(r, "## ### ### ###"),
        "sv": lambda: _digits(r, "## ###### A ###"),
        "fr": lambda: _digits(r, "# ## ## ## ### ### ##"),
        "document_id": lambda: _digits(r, r.choice(["A#######", "A##A##A##", "##AA#####", "AAA######", "#########", "A########"])),
        "birth_date": lambda: _date(r, (1935, 2012)),
        "iban": lambda: iban(r),
        "word": lambda: r.choice([_mixed(r, small(7, 14)), r.choice(FIRST).lower() + _digits(r, "####"), r.choice(["correct-horse", "purple.monkey", "quiet_river"]) + _digits(r, "-##"), r.choice(["dragonflyx", "opensesame", "swordfish"])]),
        "pin": lambda: _digits(r, r.choice(["####", "######"])),
        "key": lambda: r.choice([_mixed(r, small(20, 44)), "sk_live_" + _mixed(r, 24), _digits(r, "AAAA") + _mixed(r, 20), _mixed(r, 12) + "/" + _mixed(r, 14) + "+" + _mixed(r, 6) + "="]),
        "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))),
        "person": lambda: f"{r.choice(FIRST)} {r.choice(LAST)}" if r.random() < 0.8 else r.choice(LAST),
        "en": lambda: f"{small(1, 300)}{r.choice(['', '', 'B'])} {r.choice(STREETS['en'])} {r.choice(['Street', 'Road', 'Avenue', 'Lane', 'St'])}",
    }
    forms |= {
        "~year": lambda: str(small(1500, 2025)),
        "~small": lambda: str(small(1, 400)),
        "~section": lambda: ".".join(str(small(1, 12)) for _ in range(small(2, 3))),
        "~version": lambda: f"{small(0, 20)}.{small(0, 20)}" + (f".{small(0, 9)}" if r.random() < 0.5 else ""),
        "~date": lambda: _date(r, (1990, 2025)),
        "~time": lambda: f"{small(0, 23)}:{small(0, 59):02d}",
        "~big": lambda: r.choice([f"{small(1, 900)},{small(0, 999):03d}", str(small(1000, 99999)), f"{small(1, 9)}.{small(0, 999):03d}.{small(0, 999):03d}"]),
        "~price": lambda: f"{small(1, 999)}.{small(0, 99):02d}",
        "~digits": lambda: _digits(r, "#" * small(6, 20)),
        "~short": lambda: "".join(r.choice("0123456789abcdef") for _ in range(7)),
    }
    return forms[kind]()


def _address(form: str, r: random.Random) -> str:
    n = f"{r.randint(1, 180)}{r.choice(['', '', '', 'a', ' bis'])}"
    if form == "de":
        return f"{r.choice(STREETS['de'])}{r.choice(['straße', 'weg', 'gasse', 'platz', 'strasse', 'allee'])} {n.replace(' bis', 'b')}"
    if form == "fr":
        return f"{n}, {r.choice(['rue', 'avenue', 'place'])} {r.choice(STREETS['fr'])}"
    return f"{r.choice(['calle', 'Calle', 'avenida', 'plaza'])} {r.choice(STREETS['es'])} {n.replace(' bis', '')}"


_PLACE = re.compile(r"\{(~?[a-z_]+)(?::([a-z]+))?\}")


def labelled(seed: int = 0, fills: int = FILLS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans) of every line, filled; equal ones once."""
    r = random.Random(seed)
    out: dict[str, list[tuple[str, int, int]]] = {}
    for _ in range(fills):
        for line in LINES:
            text, at, spans = "", 0, []
            for m in _PLACE.finditer(line):
                text += line[at : m.start()]
                kind, form = m.groups()
                new = _address(form, r) if kind == "address" and form != "en" else value(form or kind, r)
                if not kind.startswith("~"):
                    spans.append((kind, len(text), len(text) + len(new)))
                text, at = text + new, m.end()
            out[text + line[at:]] = spans
    return list(out.items())
