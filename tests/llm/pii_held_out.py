"""Lines that the field has not seen, written by hand: spans stand in [kind:...]."""

import re

LINES = """
If you need anything just ring me on [phone_local:(718) 555-0100].
My new cell number is [phone_local:917-555-0144] by the way.
Praxis Dr. Lang, Telefon: [phone_local:030 12345678]
Bitte rufen Sie [phone_local:089 445566] an, wenn Sie Fragen haben.
Pour réserver, appelez le [phone_local:01 23 45 67 89] dès maintenant.
Mi teléfono es [phone_local:612 345 678] y estoy en casa.
call [phone_local:5551234567] now
phone,[phone_local:212.555.0178]
Employee SSN: [national_id:321-54-9876] (verified)
His social security number was [national_id:512-33-8841] back then.
DNI: [national_id:48573920K]
Meine Steuer-ID ist [national_id:45 678 912 303]
Votre NIR : [national_id:2 84 07 75 112 045 19]
passport [document_id:X1234567]
Passport number: [document_id:C4F7H2K90]
Reisepass [document_id:C01X00T47] ist abgelaufen
date of birth [birth_date:07/11/1979]
She was born on [birth_date:1991-03-22] and grew up there.
Geburtsdatum [birth_date:03.09.1984]
né le [birth_date:14 juillet 1962] à Paris
Fecha de nacimiento: [birth_date:21/02/1970]
IBAN [iban:DE89 3704 0044 0532 0130 00]
Please transfer to [iban:GB29NWBK60161331926819] today.
Virement : [iban:FR14 2004 1010 0505 0001 3157 249]
a token = "[secret:04dbebab91ab85687d33eeaaf9ac699e1188f962]" here
password: [secret:Sup3rS3cret99]
API key = [secret:AKx9Zq27LmPw83TbVc51RyNd04Hs]
bearer [secret:eyJhbGciOiJIUzI1NiIsInR5cCI6]
contraseña: [secret:gatoNegro77]
Passwort: [secret:Winter2019x]
My name is [person:Julia Becker] and I am new here.
Dear Mrs. [person:Johnson], we regret to say
Ich heiße [person:Lukas Hartmann] und komme aus Bonn.
Je m'appelle [person:Amélie Rousseau] et j'ai un chat.
Me llamo [person:Javier Ortega] y soy de Cádiz.
She lives at [address:17 Maple Street] with two cats.
Adresse: [address:Gartenstraße 12]
J'habite au [address:8, rue des Roses] à Nantes.
The war began in 1914 and ended in 1918.
Table 3.2 lists 45 of the 120 items.
Version 3.0.1 of 2021 is stable.
On 14/03/2015 at 9:26 the clock stopped.
The recipe takes 200 g of flour and 3 eggs.
Population: 1,234,567 (2010 census)
Order 7781234 shipped on 2020-02-02.
The key idea of this chapter is simple.
Her name was on everyone's lips.
Im Jahr 1848 gab es 39 Staaten.
Le train de 10h30 part du quai 7.
Hay 24 horas en un día y 365 en un año.
A pass over the mountains at 2,106 m
ISBN 0-306-40615-2
RFC 2616 section 14.9
x = 3.14159; y = 2.71828
Windows 10 needs 4 GB of RAM
the 100 m dash in 9.58 s
lat 48.8566, lon 2.3522
He scored 31 points in game 7.
It was named after the king.
the secret of success
""".strip().split("\n")

_MARK = re.compile(r"\[([a-z_]+):([^\]]+)\]")


def held_out():
    out = []
    for line in LINES:
        text, at, spans = "", 0, []
        for m in _MARK.finditer(line):
            text += line[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out
