"""Generated sentences with known entities, on which the model of pii.py is fitted.

The sentences were written without regard to any table: families of patterns by occasion and
language, each pattern with alternatives, so that it stands for many sentences. Whole families can be
left out and used as a test. All data are made up from parts: random digits in the layouts of several
countries, domains that are reserved for examples, roads and towns from syllables.
"""

from __future__ import annotations

import random
import re

# Patterns. «a|b|» is one of the alternatives. Entities: {n} name, {g} one part of a name, {f} a family
# name, {e} email, {p} phone, {i} identity number, {a} address. Others: {w} a word, {s} some words,
# {W} a made-up place, {P} a listed name as a place or thing, {N} a listed name that is a word, as a
# word, {h} a handle, {x} the number of a thing, {t} a date or time, {d} a small number, {m} a large one.
FAMILIES: dict[str, list[str]] = {
    "calls": [
        "«Call|Ring|Phone|Text|Dial» «me|us|him|her|them|reception» «on|at» {p}«.| please.| after six.| if you get lost.|»",
        "«Tel|Phone|Mobile|Cell|Fax|Tel.|T|Hotline»«:| :|» {p}",
        "«Which|What» number? It is {p}«.|, ask for {g}.|»",
        "You «can|may|could» reach «me|us|{n}» «by phone|during the day|at night» «on|at|under» {p}«.|, not by letter.»",
        "{p} is «my new number|the front desk|where you get us»«.| now.»",
        "For bookings «dial|ring» {p} or write to {e}«.|!»",
        "«WhatsApp|SMS|Text messages» to {p} «work best|arrive too|are read».",
        "Leave a message at {p}, {g} will call back.",
        "{n} ({p}) «organises|runs|looks after» the {w}.",
        "«In an emergency|When in doubt|If nobody opens», «call|ring|try» {p}.",
        "«Lost|Missing|Found»: one {w}. «Call|Ring|Text» {p}«.| or mail {e}.»",
        "so I dialled {p} and «nobody answered|{g} picked up|got a recording»",
    ],
    "mails": [
        "«E-mail|Mail|Email|Contact|Reply-To|From|To|Cc»: {e}",
        "«Write|Mail|Send the {w}|Forward this» to {e}«.| before noon.| and wait.|»",
        "{e} is «the right address|my inbox|no longer read|bouncing».",
        "«I use|We answer from|He gave me|Try» {e}«.| these days.| instead.|»",
        "({e})", "<{e}> wrote:", "mailto:{e}", "Questions? {e}", "Registered as {e} on {t}.",
        "{n} <{e}> «wrote|replied on {t}»:",
        "my account «is|was» {e}, «please reset it|I forgot the password»",
        "{s} {e} {s}",
    ],
    "signing": [
        "«Regards|Best wishes|Cheers|Yours|Thanks|Kind regards|Sincerely|Love|Best»,\n{n}",
        "«--|—|-» {n}", "Signed«:| by» {n}", "{s}.\n{n}", "«Yours truly|Many thanks»,\n{n}\n{a}\n{p}",
        "{n}\n{e}", "«Sent by|Posted by|Written by|Typed by|Edited by|Reviewed by|Approved by|Seen by» {n}«.| on {t}.|»",
    ],
    "greetings": [
        "«Dear|Hello|Hi|Hey|Good morning» {g}«,| and {g},|!»", "«Dear|Hello» «Mr|Ms|Mrs|Dr|Prof»«.|» {f},",
        "«Happy birthday|Well done|Good luck|Welcome back|Thank you|Thanks|Congratulations|Sorry», {g}«!|.»",
        "«hi|hey|yo» {g} «are you there|got a minute|what is up with the {w}»", "{g}, «can you|could you|please|did you» «look at|move|fix|see» the {w}«?|»",
        "«Thanks|Thank you|Kudos|Props|Greetings» to {n} for the {w}«.|!|»", "«Thanks again|See you|Goodbye|Bye» {g}«.|!|»",
    ],
    "persons": [
        "My name is {n}«.| and I live nearby.|»", "I am {n}, the new «nurse|{w} keeper|teacher|caretaker».",
        "{n} «said|says|wrote|told us|claims|thinks|asked|insists» «that it was late|nothing new|so yesterday|why»«.|»",
        "«According to|As told by|Thanks to|Together with|Because of|Unlike» {n}, «the {w} is ready|it rained|we lost».",
        "I «met|saw|know|visited|miss|trust|blame|married|thanked» {n} «yesterday|at the {w}|last week|in {W}»«.|»",
        "{n} and {n} «quarrelled|went fishing|tied the knot» «again|in {W}|»",
        "«Ask|Tell|Remind|Follow|Email|Ping|Invite|Pay|Trust» {g} «about the {w}|to bring the {w}|when you can»«.|»",
        "{g} «is|was|has been|will be» «late|away|ill|right|here|wrong» «again|today|as usual|now»«.|»",
        "«Mr|Mrs|Ms|Dr|Prof»«.|» {f} «signed|called|was not in|will see you now|retired|fixed it»«.|»",
        "the «doctor|neighbour|lawyer|plumber|coach», {n}, «agreed|left early|never came»«.|»",
        "{n}'s «car|sister|proposal|account|idea|dog» «is here|was sold|won|got stuck»«.|»",
        "«Have you seen|Do you know|Where is|Who is|Is this» {n}?", "«Neither|Not even|Only» {g} «nor|or|and» {g} «came|knew|objected».",
        "«She|He|They|We» «asked|paid|heard from|wrote to|agree with|talked to|live with|complained about» {n}«.| about it.| twice.|»",
        "It was {n} who «broke|found|wrote|paid for» the {w}.", "{n} «broke|found|painted|lost|sold|moved|deleted» «the|my|our|a» {w}«.| again.|»",
        "{n} was born in {W} and {s}.", "a «letter|gift|call|message|note» «from|for|by» {n}«.| came.|»", "«with|for|by|and|from|to» {g} «it works|we waited|nobody argued»",
        "{s} {n} {s}.", "{s} {n}.", "{s}, {g} {s}",
    ],
    "forms": [
        "«Name|Author|Patient|Customer|Applicant|Tenant|Driver|Contact person|Reporter|Owner|Assignee|Attendee|Speaker|User»: {n}",
        "Present: {n}; {n}; {n}", "Name: {n}\nAddress: {a}\nPhone: {p}\nEmail: {e}", "name={n}, id={i}, phone={p}",
        "«Passport|Passport no.|Passport number|ID|ID card|SSN|NI number|Insurance no.|Tax id»«:| -|» {i}",
        "Holder: {n}, «passport|identity card|ID» {i}, issued {t}.", "{n} ({i})", "1. {n}\n2. {n}", "| {n} | {t} | {d} |",
        "Born: {t}\nName: {n}\nID: {i}", "«Ship to|Deliver to|Bill to|Home|Office|Address|Location»: {a}", "{n}\n{a}",
        "«Guest|Passenger|Visitor» {n} «arrived|left|signed in» at {t}.",
    ],
    "identity": [
        "My «social security number|SSN|social|insurance number|national insurance number|NI number|identity number|tax id|passport number» is {i}«.|, keep it safe.|»",
        "«The applicant|The tenant|The visitor|{n}» «gave|showed|entered|left» «passport|identity card|ID|social security number» {i}«.| at the desk.|»",
        "«Someone|The clerk|I» typed «the social security number|SSN|the insurance number|my passport» {i} into the «form|chat|wrong box».",
        "«insurance|passport|identity|social security» «no.|number|nr» {i} belongs to {n}«.|»", "they asked for «my|a» passport and I sent {i}, «was that wise|is that bad»?",
        "«On|In» the «copy|scan|photo» one can read the «identity|passport|social security» number {i}«.| clearly.»", "«ssn|passport|social|national id» {i}", "«verified|checked» with id {i} «yesterday|by {n}»",
    ],
    "homes": [
        "«I live|We live|She lives|He stays|They stay|We met|The party is» at {a}«.| since May.| now.|»", "«Have|Get» the «crate|envelope|{w}» «shipped|brought» to {a}«.| please.|»",
        "The «house|shop|office|clinic|flat» at {a} is «empty|for sale|closed|ours»«.|»", "{a} is «where we park|our new office|hard to find|the place».",
        "«relocating|heading» to {a} «next spring|shortly|with {g}»", "«Come|Go|Drive|Walk» to {a}, «ring twice|second floor|the door is open».", "{n} of {a} «complained|won|moved out».",
        "«Pick me up|Meet me|Collect it|Wait» «at|outside|in front of» {a}«.| at {t}.|»", "My «address|home address|new place» is {a}«.|, ring {p}.|»", "{s} {a}. {s}", "«found|lost|saw» a {w} «near|by|at» {a}",
    ],
    "things": [
        "«Ticket|Order|Invoice|Parcel|Case|Thread|Run|Build|Job|Batch|Part|Issue|Shipment|Booking|Request» «no. |number |#||id |nr. »{x} «is closed|has shipped|failed|was refunded|is late»«.|»",
        "«See|Check|Reopen|Merge|Track|Quote|Mention» «ticket|order|invoice|run|thread|case|job|issue|parcel|build» «no. |#||number »{x}«.| please.|»",
        "«tracking code|order number|serial number|article number|invoice number|run id|thread id|ticket number|reference» «is |: |=|»{x}",
        "«The|Our» «run|job|build|order|ticket» {x} «took {d} minutes|broke at {t}|is done».", "ftp://{h}.test/{w}-{x}", "error {d} in line {m}", "log {x}: {s}",
        "{m} «views|people|rows|steps|tokens|bytes» «in {d} days|so far|and counting»«.|»", "«Scores|Odds|Ratios» of {d}-{d} and {d}:{d}.", "Opened {t}, closed {t}.", "on {t} «it|we» «rained|stopped|lost»", "version {d}.{d}.{d} of the {w}",
        "from {m} to {m}, about {d} percent", "«numbers|values|data»: {d} {d} {d} {m} {d}", "ISBN {d3}-{d}-{d4}-{d4}-{d1}", "IP 10.{d}.{d}.{d}", "the «code|PIN|password» is {d4}", "{d} + {d} = {d}", "«card|account|meter» reading {d4} {d4} {d4} {d4}", "id {d} of {d}, row {m}", "pages {d}-{d}, chapter {d}",
    ],
    "figures": [
        "«loss|accuracy|lat|lon|price|rate|mean|score|p|x» «of |= |: |»{q}«, |/| »{q}", "{q} {q} {q}", "«it|the {w}» «costs|weighs|measures» {q} «kilos|metres|euros|dollars|percent»«.|»", "{t} {q} {d}/{d} -{d}", "[{t}] step {m} loss {q}", "{d}/{d} -{d} {q}", "lr={q}, {d}/{d}", "{q}, {q}\n{q}, {q}",
        "at {d1} p.m. «The|A|Our» {w} «closed|rang|fell».", "I'm «late|here|done|{w}» and you're «not|next».", "{d} m. The {w} «is|was» {d} cm.", "c. {d4}, vol. {d}, pp. {d}-{d}", "«Dr|St|No|Mr» {d}", "e.g. a {w}, i.e. the {w}, etc. Then {s}.",
    ],
    "streets": [
        "{d} «old|quiet|long|narrow|new» «streets|roads|lanes» «later|away|behind us».", "the road to {W} is «closed|long|wet»«.|»", "a «street|road|lane» with {d} lamps", "{d} «people|trees|cats» «on the|in the|by the» «hill|square|street|park»«.|»",
        "Park and walk for {d} minutes.", "the «avenue|drive|row|court» has {d} «trees|houses|gates»", "turn left after {d} «roads|streets|lanes»«.|»", "take the second lane on the drive home", "a {d} way tie", "it is {d} square metres", "{d} «ways to|places to|rows of» {w}",
        "«Streets|Roads» {d} to {d} «flooded|reopened» «.|after {d} nights|»", "{d} days on the road", "we need {d} «of the|for the|more for our» way home", "{d} {w} «street lights|road signs|place cards»", "route {d}, exit {d}, then the close on the hill", "{d} steps from the {W} Park",
    ],
    "places": [
        "«in|near|from|to|around|through|towards» {W} «it rains|we stopped|nobody lives»«.|»", "{W} is a «town|river|lake|village|harbour»«.|»", "the {W} «Museum|Bridge|Station|River|Institute|Festival|Library|Valley»", "«Flights|Trains|Buses|Letters» from {W} to {W} «are late|stop here»«.|»",
        "the «town|village|lake|river|port|county» of {P}«.| is small.|»", "«in|near|outside» {P} «Valley|County|Bay|Harbour»«.|»", "{P} «Lake|Airport|River|Hill|Beach|Junction|University|Hall»", "the {P} «prize|effect|theorem|method|award|bridge|engine|sauce|recipe|model»", "«The weather in|A map of|The mayor of» {W} «changed|is old»«.|»",
        "«We|They|I» «moved|went|drove|flew» to {W} «in {d} days|last year»«.|»", "{W}, {W} and {W} «are towns|flooded|voted»«.|»", "«Mayor of|News from|Back in» {W}:",
    ],
    "handles": [
        "@{h} «agreed|posted this|is banned»«.|»", "«user|u/|account|player|nick|handle» {h}{d} «left|joined|cheats»", "see {h}_{d} and {h}.{h} for the {w}", "#{h} «is trending|again|»", "ftp://{h}.test/{h}/{w}.txt", "/home/{h}/{w}/{d}", "git checkout {h}/{w}", "{h}_{w} = {d}", "«ping|cc|thanks|follow» @{h} «and @{h}|please|»", "$ {h} --{w} {d}", "<{h}>{w}</{h}>", "import {h}.{w}", "wiki/{h}_{h}",
    ],
    "words": [
        "the {N} «is|was|looks|got» {w}«.| again.|»", "a {N} «by|on|in|under|near» the {N}«.|, and {d} more.|»", "«in|every|last|next» {N} «the {w} sleeps|we move|it ends»", "{N} «comes|came|starts|falls|is» early this year«.|»", "«such a|one more|what a|any|no» {N} «day|one|again»", "«my|our|your|their|this|that|some» {N} «is gone|works|was free»«.|»", "«fetch|sketch|wrap» «the|some» {N} «for the {w}|at once»",
        "{N}, {N} and {N}", "«at|by|until|before|from» {N}, {N} «and a {w}|was in sight|again»«.|»", "{N} {N} «soup|tea|cake|paint|club»", "I miss «the|my» {w}", "they miss {w}, {N}, everything", "«with|without|like|of» «a|the» {N} «it works|and a {w}»", "{N} and {w}«.|, as always.|»", "«hardly|quite» enough {N} for «that|this» {w}", "«white|red|old|wild|small|wet|cold» {N} «for sale|in the yard|everywhere»", "to {N} or not to {N}", "I «will|may|can|must|might» {N} «it|tomorrow|the {w}»", "The {w} and the {N} «broke|are here|sank».",
        "«Note|Update|Summary|Reminder|Warning|Agenda»: {s}.", "{s}.", "{s}, {s}.", "«Meet|Look|Mail|Start» at «noon|{d} pm», dot the i and cross the t.", "He said that at best the «dot|point» is missing.",
    ],
    "german": [
        "«Ruf|Rufen Sie» «mich|uns» «an|bitte an»: {p}", "Meine «Nummer|Handynummer|neue Nummer» «ist|lautet» {p}.", "«Mit freundlichen Grüßen|Viele Grüße|Liebe Grüße|Gruß|Danke»,\n{n}", "«Herr|Frau» {f} hat «unterschrieben|angerufen|recht»«.|»", "«Ich wohne|Wir treffen uns|Das Büro liegt» in der {a}«.|»", "«Personalausweis|Reisepass|Ausweisnummer|Sozialversicherungsnummer»«:| Nr.|» {i}",
        "«Bestellung|Auftrag|Rechnung|Vorgang» {x} ist «unterwegs|bezahlt|erledigt».", "Bitte an {e} «antworten|schicken|weiterleiten»«.|»", "{n} kommt «morgen|heute» nach {W}«.|»", "«Der|Die|Das» {w} von {g} «ist weg|steht da|war teuer»«.|»", "Adresse: {a}", "Es gibt {d} Straßen und {d} Plätze in {W}.", "Wir haben {d} Tage gewartet und nichts gehört.", "Telefon: {p}, Mail: {e}", "«Hallo|Lieber|Liebe|Guten Tag» {g},",
    ],
    "french": [
        "«Appelez|Appelle|Contactez»-moi au {p}.", "Mon «numéro|portable|téléphone» est le {p}.", "«Cordialement|Bien à vous|Bises|Merci»,\n{n}", "«J'habite|Nous habitons|Rendez-vous» au {a}«.|»", "«Monsieur|Madame» {f} n'est pas «là|venue|d'accord».", "«Passeport|Carte d'identité|Numéro de sécurité sociale» «n° |: |»{i}", "«Commande|Facture|Dossier|Colis» «n° |»{x} «expédiée|payé|perdu».", "«Écris|Écrivez|Répondez» à {e}«.| avant midi.|»", "{n} est «arrivé|partie|né» hier à {W}.", "«Bonjour|Salut|Chère|Cher» {g},", "Il y a {d} rues et {d} places à {W}.", "«Voici|C'est» la {w} de {g}, «je crois|merci».", "Téléphone : {p}", "Adresse : {a}",
    ],
    "spanish": [
        "«Llámame|Llame|Escríbeme» al {p}«.| por favor.|»", "Mi «teléfono|móvil|número» es «el |»{p}.", "«Saludos|Un abrazo|Atentamente|Gracias»,\n{n}", "«Vivo|Vivimos|La oficina está|Nos vemos» en «la |»{a}«.|»", "«Al señor|A la señora» {f} «le duele|le gusta|le falta» «algo|la {w}».", "«DNI|Pasaporte|NIE|Documento»«:| nº|» {i}", "Mi «DNI|pasaporte» es {i}«.|, por si acaso.»", "«Pedido|Factura|Expediente|Envío» {x} «enviado|pagada|cerrado».", "«Escribe|Escriban|Manda» a {e}«.| antes del lunes.|»", "{n} «llega|vive|nació» «mañana|ahora» en {W}.", "«Hola|Querida|Estimado» {g},", "«Sí|Claro|Gracias», «señor|señora». {s}.", "Hay {d} calles y {d} plazas en {W}.", "la {w} de {g} «es nueva|se rompió»", "Tel.: {p}", "Dirección: {a}",
    ],
    "portuguese": [
        "«Liga|Ligue|Manda mensagem» para «o |»{p}.", "O meu «telefone|número|telemóvel» é «o |»{p}.", "«Abraços|Cumprimentos|Obrigada|Atenciosamente»,\n{n}", "«Moro|Moramos|A loja fica» na {a}«.|»", "«O senhor|A senhora» {f} não «veio|assinou».", "«CPF|Passaporte|Cartão de cidadão|RG»«:|» {i}", "«Encomenda|Fatura|Processo» {x} «enviada|paga».", "«Escreve|Escrevam|Responde» para {e}«.|»", "{n} «chega|mora» «amanhã|agora» em {W}.", "«Olá|Cara|Caro» {g},", "São {d} ruas e {d} praças em {W}.", "Telefone: {p}", "Endereço: {a}",
    ],
    "chats": [
        "{g}: {s}\n{g}: {s}", "[{t}] {g}: {s}", "«lol|omg|btw|imo|tbh» {g} «u there|is wild|said so|again»", "«anyone|has somebody» seen {g}? «call|text» {p}", "«dm|mail» me {e} «thx|pls|»", "{g} {g} {g} «where are you|wake up»", "nvm {g} fixed the {w}", "idk ask {n}", "«rt|via» @{h}: {s}", "k, {a} at {t} then", "{g}?? «no way|really|hm»", "new phone, who dis: {p}", "«yes|no|maybe», {g}«.|!| knows|»",
    ],
}

WORDS = "pencil shelf button saddle kettle bucket copper ribbon basket candle hammer needle pillow bottle anchor barrel blanket cabinet curtain drawer fiddle hinge jacket lantern mirror napkin paddle puzzle rocket sponge trophy violin wagon whistle zipper broom crate stamp sweater magnet".split()
_SMALL = "the a of and to in is it was on for with that as but not so very then still often we they she he you it".split()
# Words for streets, by language.
_STREETS = "Street St. Road Rd. Lane Ln Way Avenue Ave Court Crescent Drive Dr Boulevard Blvd Close Place Terrace Row Square Gardens".split()
_GERMAN = "straße strasse weg allee platz gasse str. ring ufer".split()
_ROMANCE = ["Calle", "Avenida", "Paseo", "Plaza", "Camino", "Rua", "Travessa", "Praça", "Via", "Largo", "R.", "Av."]
_FRENCH = ["rue", "avenue", "impasse", "boulevard", "quai", "place", "allée", "chemin"]
_LINKS = ["", "", "de ", "del ", "de la ", "de los ", "do ", "da ", "das "]
_DIGITS = "zero one two three four five six seven eight nine".split()


class Maker:
    def __init__(self, given: list[str], family: list[str], ordinary: list[str], heads: list[str], tails: list[str], seed: int, families: list[str]):
        self.r = random.Random(seed)
        self.given, self.family, self.ordinary = given or ["Ilmora"], family or ["Tandervik"], ordinary or ["stone"]
        self.heads, self.tails = heads, tails
        self.patterns = [FAMILIES[f] for f in families]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def number(self, groups: str, sep: str = " ") -> str:
        """Groups of random digits, the first without a leading zero."""
        out = [self.digits(int(g)) for g in groups]
        return sep.join([str(self.r.randint(1, 9)) + out[0][1:], *out[1:]])

    def syllables(self, least: int = 2, most: int = 4) -> str:
        return "".join(self.r.choice("bcdfghklmnprstvw") + self.r.choice(["a", "e", "i", "o", "u", "ei", "ou", "á", "ö"] if self.r.random() < 0.2 else "aeiou") for _ in range(self.r.randint(least, most))) + self.r.choice(["", "", "n", "r", "s", "l", "th", "nd"])

    def place(self) -> str:
        return self.syllables().capitalize() + (" " + self.syllables().capitalize() if self.r.random() < 0.1 else "")

    def part(self, listed: list[str]) -> str:
        """A listed name, now and then one made like them, or one that nobody listed."""
        x = self.r.random()
        if x < 0.12 and self.heads and self.tails:
            return (self.r.choice(self.heads) + self.r.choice(self.tails)).capitalize()
        if x < 0.2:
            return self.syllables().capitalize() if self.r.random() < 0.6 else self.r.choice(WORDS).capitalize()
        return self.r.choice(listed)

    def name(self) -> str:
        r, g = self.r, self.r.choice(self.given)
        f = self.part(self.family)
        if r.random() < 0.12:
            f += "-" + self.part(self.family)
        if r.random() < 0.12:
            g = self.part(self.given) if f in self.family else g
        x = r.random()
        i = r.choice("ABCDEFGHIJKLMNOPRSTVW") + "."
        return g if x < 0.06 else f"{f}, {g}" if x < 0.2 else f"{g} {i} {f}" if x < 0.32 else f"{g[0]}. {f}" if x < 0.39 else f"{g} {f}"

    def one(self) -> str:
        """A name that stands alone, listed or made like those; seldom one that is a word too."""
        r = self.r
        if r.random() < 0.12 and self.heads and self.tails:
            return (r.choice(self.heads) + r.choice(self.tails)).capitalize()
        out = r.choice(self.given if r.random() < 0.5 else self.family)
        return self.one() if out.lower() in self.ordinary and r.random() < 0.9 else out

    def email(self) -> str:
        r = self.r
        g, f, w = re.sub(r"\W", "", r.choice(self.given).lower()), re.sub(r"\W", "", self.part(self.family).lower()), r.choice(WORDS)
        local = r.choice([f"{g}.{f}", f"{f}_{g}", f"{g}{r.randint(1, 99)}", f"{g}+{w}", f"{g}-{f}", f"{g[0]}{f}", f"{f}.{w}", w + self.digits(2), w, f"{g}.{f}{self.digits(2)}"])
        host = r.choice([self.syllables(), w, "mail." + w, "example", self.syllables() + "-" + w])
        domain = host.encode("ascii", "ignore").decode() + r.choice([".example", ".test", ".invalid", ".example.com", ".example.org", ".example.net"])
        x = r.random()
        if x < 0.26:
            at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT "), (" arroba ", " punto ")])
            return (local if dot == "." else local.replace(".", dot) if r.random() < 0.5 else local) + at + domain.replace(".", dot)
        out = f"{local}{'＠' if x < 0.32 else '@'}{domain}"
        return out.upper() if r.random() < 0.07 else out

    def phone(self) -> str:
        r, n = self.r, self.number
        out = r.choice([
            lambda: f"+1 {n('334')}", lambda: f"+1-{n('334', '-')}", lambda: f"1 ({n('3')}) {n('34', '-')}", lambda: f"1 ({n('3')}) {n('7')}", lambda: f"({n('3')}) {n('34')}", lambda: f"({n('3')}) {n('34', '-')}", lambda: n("334", "-"), lambda: n("334", "."), lambda: n("334", " "), lambda: n("334", ""), lambda: n("34", "-"), lambda: f"{n('3')} {self.digits(2)} {self.digits(2)}",
            lambda: f"+44 {n('4')} {self.digits(6)}", lambda: f"+44{n('46', '')}", lambda: f"0{n('46')}", lambda: f"+44 (0){n('2')} {n('44')}", lambda: f"0{n('244')}", lambda: f"+49 {n('253')}", lambda: f"0049 {n('253')}", lambda: f"0{n('2')}/{n('53', '-')}", lambda: f"0{n('2')}/{n('7')}", lambda: f"0{n('38')}",
            lambda: f"+33 {n('1')} {n('2222')}", lambda: f"0{n('12222')}", lambda: f"0{n('12222', '.')}", lambda: f"+34 {n('333')}", lambda: n("3222"), lambda: f"+351 {n('333')}", lambda: f"+55 {n('2')} {n('5')}-{self.digits(4)}", lambda: f"({n('2')}) {n('44', '-')}", lambda: f"+{n('2')} {n('8')}",
            lambda: r.choice([" ", "-", ", "]).join(r.choice(_DIGITS) for _ in range(r.randint(7, 11))),
        ])()
        if r.random() < 0.12 and out[-1].isdigit():
            out += r.choice([" ext {}", " ext. {}", " x{}", ", ext. {}", " extension {}"]).format(r.randint(2, 999))
        return out

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTXYZ") for _ in range(n))

    def identity(self) -> str:
        r, d, sep = self.r, self.digits, self.r.choice(["-", " ", "", "."])
        return r.choice([
            lambda: f"{d(3)}{sep}{d(2)}{sep}{d(4)}", lambda: f"{self.letters(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", lambda: f"{self.letters(2)}{d(6)}{r.choice('ABCD')}", lambda: f"{self.letters(r.randint(1, 2))}{d(r.randint(6, 8))}",
            lambda: f"{self.letters(2)}{r.choice(' -')}{d(3)}{r.choice(['', ' ', '-'])}{d(4)}", lambda: f"{d(8)}{r.choice(['', '-', ' '])}{self.letters(1)}", lambda: f"{d(7)}{r.choice(['-', ''])}{self.letters(1)}", lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", lambda: d(r.choice([9, 9, 10, 11])),
        ])()

    def thing(self) -> str:
        """The number of an order, a run and the like, often in the layout of something personal."""
        r, d = self.r, self.digits
        return r.choice([lambda: d(r.randint(5, 12)), lambda: d(9), lambda: self.letters(r.randint(1, 3)) + d(r.randint(4, 9)), lambda: self.letters(2) + "-" + d(3) + "-" + d(4), lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(4)}-{d(6)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(8)}{self.letters(1)}"])()

    def road(self) -> str:
        return self.r.choice([self.syllables, lambda: self.r.choice(WORDS), lambda: self.r.choice(self.ordinary), lambda: self.r.choice(self.family)])().capitalize()

    def address(self) -> str:
        r, form, town = self.r, self.r.random(), self.place()
        code = self.digits(r.choice([4, 5, 5, 5]))
        if form < 0.66:
            number = str(r.randint(1, 240)) + (r.choice(["A", "B", "b", "c", "/2", "/4"]) if r.random() < 0.25 else "")
            out = f"{number} {self.road()}{r.choice([' ' + self.road(), ' Hill', ' Park', ' Green', ' View']) if r.random() < 0.25 else ''} {r.choice(_STREETS)}"
            if r.random() < 0.15:
                out = out.lower()
            if r.random() < 0.3:
                out += r.choice([", Flat {}", ", Apt {}B", " #{}", ", Unit {}", ", Apt. {}", ", Suite {}"]).format(r.randint(1, 60))
            return out + (r.choice([f", {town}", f", {town} {code}", f", {code} {town}"]) if r.random() < 0.45 else "")
        if form < 0.8:
            stem = r.choice([self.syllables(), r.choice(WORDS), self.r.choice(self.family)]).capitalize()
            out = f"{stem}{r.choice(_GERMAN)} {r.randint(1, 240)}{r.choice(['', '', '', 'b', 'a', ' c'])}"
            return out + (f", {code} {town}" if r.random() < 0.5 else "")
        if form < 0.91:
            out = f"{r.choice(_ROMANCE)} {r.choice(_LINKS)}{self.road()}{r.choice([', ', ' ', ' nº ', ', nº '])}{r.randint(1, 240)}"
            if r.random() < 0.35:
                out += f", {r.randint(1, 9)}{r.choice('ºª')}" + r.choice(["", " A", " B", " C"])
            return out + (r.choice([f", {code} {town}", f", {town}"]) if r.random() < 0.3 else "")
        out = f"{r.randint(1, 240)}{r.choice(['', '', ' bis', ' ter'])}{r.choice([', ', ' '])}{r.choice(_FRENCH)} {r.choice(['', 'du ', 'des ', 'de la ', 'de '])}{self.road()}"
        return out + (f", {code} {town}" if r.random() < 0.35 else "")

    def when(self) -> str:
        r = self.r
        y, m, d, h, s = r.randint(1990, 2030), r.randint(1, 12), r.randint(1, 28), r.randint(0, 23), r.randint(10, 59)
        return r.choice([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{h}:{s}", f"{y}-{m:02}-{d:02} {h:02}:{s}", f"{d} May {y}", f"{y}-{m:02}-{d:02}T{h:02}:{s}:00"])

    def some(self) -> str:
        r = self.r
        return " ".join(r.choice(_SMALL) if r.random() < 0.4 else r.choice(WORDS) if r.random() < 0.5 else self.syllables().lower() for _ in range(r.randint(2, 7)))

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        pattern = r.choice(r.choice(self.patterns))
        pattern = re.sub("«(.*?)»", lambda m: r.choice(m[1].split("|")), pattern)
        out, spans = "", []
        for piece in re.split(r"(\{\w+\})", pattern):
            if not (piece[:1] == "{" and piece[-1:] == "}"):
                out += piece
                continue
            slot = piece[1:-1]
            made, kind = {
                "n": lambda: (self.name(), "name"), "g": lambda: (self.one(), "name"), "f": lambda: (self.part(self.family), "name"), "e": lambda: (self.email(), "email"), "p": lambda: (self.phone(), "phone"),
                "i": lambda: (self.identity(), "id_number"), "a": lambda: (self.address(), "address"), "w": lambda: (r.choice(WORDS + self.ordinary[:4]), None), "W": lambda: (self.place(), None), "s": lambda: (self.some(), None),
                "P": lambda: (r.choice(self.family if r.random() < 0.6 else self.given), None), "N": lambda: (r.choice(self.ordinary), None), "h": lambda: ((r.choice(self.given) if r.random() < 0.5 else self.syllables()).lower(), None),
                "x": lambda: (self.thing(), None), "q": lambda: (f"{r.choice(['', '-'])}{r.choice([0, 0, r.randint(1, 9), r.randint(1, 180), r.randint(1, 9999)])}.{self.digits(r.randint(1, 7))}", None), "t": lambda: (self.when(), None), "d": lambda: (str(r.randint(2, 999)), None), "m": lambda: (r.choice([str(r.randint(1000, 10**9)), f"{r.randint(1, 999)},{self.digits(3)}", f"{r.randint(1, 99)}.{self.digits(5)}", f"{r.randint(1, 999)} {self.digits(3)}"]), None),
            }.get(slot, lambda: (self.digits(int(slot[1:])), None))()
            if slot in "Nsw" and not out.strip():
                made = made[:1].upper() + made[1:]
            if kind:
                spans.append((len(out), len(out) + len(made), kind))
            out += made
        return out, spans

    def example(self) -> tuple[str, set[tuple[int, int, str]]]:
        """Some sentences in a row, now and then all in one case."""
        text, truth = "", set()
        join = self.r.choice([" ", " ", "\n", "\n\n"])
        for _ in range(self.r.randint(1, 3)):
            s, spans = self.sentence()
            if text:
                text += join
            truth |= {(a + len(text), b + len(text), k) for a, b, k in spans}
            text += s
        x = self.r.random()
        changed = text.upper() if x < 0.08 else text.lower() if x < 0.18 else text
        return (changed if len(changed) == len(text) else text), truth


def examples(given: list[str], family: list[str], ordinary: list[str], heads: list[str], tails: list[str], n: int, seed: int = 11, families: list[str] | None = None) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """`n` generated texts with their entities, of all or the given families of patterns; the same for
    the same lists."""
    make = Maker(sorted(given), sorted(family), sorted(ordinary), sorted(heads), sorted(tails), seed, families or list(FAMILIES))
    return [make.example() for _ in range(n)]
