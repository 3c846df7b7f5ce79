"""Training of the field's weights on generated labelled texts: ``python -m loomline.llm.pii_train``.

Texts are composed from sentence patterns with slots; the slots of personal
information give the labels.  ``SAMPLE`` bounds their number.  Names, streets
and towns are made of syllables; of the names of a text only some are in the
lexicon that goes with it, so the field learns to do without.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import defaultdict

from loomline.llm.pii import GIVEN, KINDS, NEAR, WEIGHTS, WORDLIKE, Field, Lexicon, candidates, pair_of

SAMPLE = 6000

PATTERNS = """
Hi {one},;Hello {one};Hey {one}!;Hey {name}!;hey {name}!;hi {one}!;Dear {one},;Good morning {one},;Dear {name},;Hello {name};Hola {one},;Bonjour {name},;{one},;{name},;Liebe {one},;Hej {one}!;Ciao {one},;
Bonjour {one}, merci.;Bonjour {one}, We met.;Bonjour {one},;Hola {one}: Gracias.;Hola {one}:;Hallo {one}, danke.;Lieber {one},;Cher {one},;Caro {one},;Olá {one},;Guten Tag {one},;Buenos días {one}:;
I met {name} in {town}.;I met {name} and liked it.;Kind regards
{name}
Senior Buyer;Thanks
{name};Best
{name};Regards
{name}
{cap} {firm};{one};{name};{lower};- {one};- {name};— {one};{name}, Head of Operations;{name} | Sales;Best wishes,
Regards,
{name};Thanks,
{one};Many thanks
{name}
Senior Buyer;Cheers
{lower};From: {name};To: {name};From: {name} <{email}>;Cc: {name}, {name};Von: {name};
Say hello to {one} from me.;Say hello to {name} for us.;We met {name} and {one} yesterday.;You can ask {name} about it.;I spoke to {one} on {day}.;I spoke with {name} on {day}.;My name is {name}.;my name is {name} and I live in {town}.;I am {name} from Sales.;I met {name}.;They called {name} again.;Please contact {name} for keys.;We asked {name} to help.;We invited {name}.;She reports to {name}.;Signed by {name}, our clerk.;This is {name} from the bank.;
{name} told me to write.;{one} told me to write.;Dr. {name} runs the lab.;Dr. {one} leads the team.;Prof. {one} agrees.;We will meet {name} and {one} there.;We will meet {one} and {name} there.;Mr. {fam} called twice.;{name} from Accounts joins us.;{one} from Legal joins us.;{name} will present.;{one} will present.;It was {one} who found it.;The report by {name} is late.;
The figures that {name} sent are fine.;According to {one}, it is done.;Could {one} come too?;Could {name} come too?;Please thank {name} for lunch.;{one} and {name} agree.;Signed by {name}.;Was it {name}?;I owe {one} a call.;Tell {one} that I agree.;
i spoke to {lowname} last week.;please ask {lowname} for the file.;say hello to {lowname}.;
On Tue, Mar 4, 2025 at 8:15, {name} <{email}> wrote:;{name} wrote on 2025-03-04:;Le 4/3/2025 à 8:15, {name} <{email}> a écrit :;El 4/3/2025 a las 8:15, {name} escribió:;Am 4.3.2025 um 8:15 schrieb {name}:;Quoting {name} <{email}>:;Il 4/3/2025 {name} ha scritto:;
Mark {day} as a holiday.;Mark my words, it will rain.;Hope {day} is fine.;Hope to see you soon.;Hope all is well.;Will the boxes arrive?;Will you send the list?;Will we need more tea?;Will our guests be late?;Will a second van do?;Will training plans come up?;Will two rooms be enough?;Will file {path} do?;Will order forms come up?;Will message lists be there?;Will night shifts end?;May I ask one thing?;May brings rain.;On Mon, May 4, 2025 at 8:15, {name} <{email}> wrote:;On Sat, June 4, 2025 at 9:15 {name} wrote:;It was May 12, 2025.;By June 3 it is due.;April 9 is free.;
The Hope fund opens in {town}.;The Grace trust opens in May.;The Faith trial ended in June.;From June on we are open.;In June we moved.;Since April it is quiet.;By dawn on {day} it was over.;Bill of lading attached.;Bill payments are due.;Art classes are full.;Rose gardens need care.;Penny stocks fell.;Sky blue is fine.;Miles of road were laid.;Drew the plan on {day}.;Grace periods end.;Joy rides are banned.;Faith in data is not enough.;Dawn breaks late.;June figures are in.;April was slow.;
Sorry for the delay, April was busy.;It ends in May.;Until June then.;Mark up the draft, please.;Bill me later.;We grow roses and mark exams.;Max speed is low.;Jack up the car.;
Hi {one} The parcel came today.;Hello {one} We moved the date.;Dear {one} I have a list for you.;Hi {one} Sorry for that.;Hey {one} After lunch then.;Good morning {one} My plan is done.;Hi {one} We saw it.;Hi {one} I like it.;Hello {name} The list is here.;Hi {name} We met in {town}.;Dear {name} Please sign.;{one} and {one}.;for {one} and {name}.;
Regards,
{name}
Senior Buyer
{cap} {cap} {firm}
T {phone};Thanks,
{one}
{cap} {cap} {firm};Kind regards
{name}
Head of Sales
{cap} {firm}
m. {phone};All the best,
{one}
Recruiter
{cap} {cap} {firm} {firm};{name} | Talent Partner
{cap} {cap} {firm}
{phone};{name}
Clerk
{cap} {cap} {firm};Recruiter
{cap} {cap}
{phone};
Call {phone} and ask for Sales.;My number is {phone} if you need it;mobile: {phone};Tel {phone} (office);Reach us on {phone}.;direct {phone};T {phone};m. {phone};{phone};Phone: {phone} | {email};fax {phone};
Write to {email} by {day}.;Send it to {email}; thank you;cc {email};Copy {email} in, please.;Use {email} after {day}.;mail {email};
The SSN is {ssn}, as said.;{ssn};It is {ssn} now.;{other};It is {other}, as asked.;It is {tax}.;SSN: {ssn};my social security number is {ssn};social security number: {ssn};the social security number {ssn} is hers.;National ID: {other}.;tax ID: {tax};My tax number is {tax}, as said.;driving licence: {other};Passport no. {other};passport: {other};they asked for my passport too ({other});DNI {dni};NIE: {nie};Aadhaar {aad} was given.;Aadhaar: {aad};
I live at {address}.;Our home is {address}, near the park.;Post it to {address};We meet at {address} on {day}.;Deliver to {address}.;{address};Head office: {address}. Registered number 00611824.;Address: {address};
Ticket {ticket} is closed.;The bill was $64.20, ticket {ticket}.;Invoice {invoice} is paid.;Invoice {invoice} was sent.;Build 3.11.9 is out; order 2025-118-0041 is for it.;The server is at 10.4.18.77 today.;Requisition R-2718281 is open, and the pay is $90,500.;Since 2017 we rent in {town}.;We sit in Room 12, floor 3.;Registered number 007311245.;Case {caseno} is open.;Order {caseno} shipped.;
https://files.example/{path};The team reports to the board in {town}.;{town} is 14 stops away.;Would you take a Clerk post in {town}?;The {town} office is shut.;{cap} Systems is hiring.;We work with {cap} {cap} Ltd.;At {cap} {cap} we build boats.;{cap} group;{cap} {cap};Data Engineer, {cap} Tooling;Harbour Review;Re: {cap} {cap};The {cap} {cap} desk is closed.;From {cap} {cap} to {town}.;Dear Hiring Manager,;Dear Sir or Madam,;Hi all,;Hi team;Kind regards
{one};Hello there,;Ask Sales for it.;Meet us in {town}.;This is {cap} Systems.;To: Sales Team;From: nine to five is fine.;I am Senior Buyer there.;thanks to {cap} Tooling;Contact Support first.;
"""
_TOWNS = ("Port", "Lower", "San", "New", "")


class _Maker:
    """Names, towns and numbers of one run, from syllables."""

    def __init__(self, r: random.Random):
        self.r = r
        part = lambda: r.choice("b d f g h j k l m n p r s t v w br dr gr kl st tr sh th".split()) + r.choice("a e i o u ai ea ou ie á é ö".split())
        self.word = lambda n: ("".join(part() for _ in range(n)) + r.choice(["", "n", "r", "s", "l", "m", "k", "rt", "nd", "ll", "sson", "well", "ez", "ski"])).title()
        self.given = [self.word(r.choice([1, 2, 2])) for _ in range(900)]
        self.family = [self.word(r.choice([1, 2, 2, 3])) for _ in range(1500)]
        known = lambda names: frozenset(x.lower() for x in r.sample(names, len(names) * 6 // 10))
        self.lexicon = Lexicon(known(self.given), known(self.family))
        self.listed = sorted(GIVEN - WORDLIKE)

    def first(self) -> str:
        x = self.r.random()
        if x < 0.3:
            return self.r.choice(sorted(WORDLIKE)).title()
        if x < 0.6:
            return self.r.choice(self.listed).title()
        return self.r.choice(self.given) if x < 0.95 else f"{self.r.choice(self.given)}-{self.r.choice(self.given)}"

    def last(self) -> str:
        name, x = self.r.choice(self.family), self.r.random()
        return f"O'{name}" if x < 0.05 else f"van der {name}" if x < 0.1 else f"{name}-{self.r.choice(self.family)}" if x < 0.15 else f"de {name}" if x < 0.18 else name

    def digits(self, k: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(k))

    def fill(self, slot: str) -> tuple[str, str | None]:
        r, d = self.r, self.digits
        first, last = self.first(), self.last()
        if slot == "one":
            return first, "name"
        if slot == "lower":
            return first.lower(), "name"
        if slot == "lowname":
            return f"{first} {last}".lower(), "name"
        if slot == "fam":
            return last, "name"
        if slot == "name":
            full = r.choice([f"{first} {last}"] * 5 + [f"{first[0]}. {last}", f"{first} {r.choice('ABCDEFG')}. {last}", f"{last}, {first}"])
            return (full.upper() if r.random() < 0.05 else full), "name"
        if slot == "email":
            local, domain = f"{first.lower()}.{last.split()[-1].lower()}{d(1)}".replace("'", ""), r.choice(["post.example", "mail.firm.test"])
            return r.choice([f"{local}@{domain}"] * 3 + [f"{local}(at){domain}", f"{local} AT {domain}", f"{local} [at] {domain.replace('.', ' [dot] ')}"]), "email"
        if slot == "phone":
            base = r.choice([f"+1 {d(3)} 555 0{d(3)}", f"({d(3)}) 555-0{d(3)}", f"+1{d(3)}5550{d(3)}", f"{d(3)}.555.0{d(3)}", f"{d(3)}-555-0{d(3)}", f"+44 1632 960{d(3)}", f"+49 30 {d(7)}", f"+39 06 {d(4)} {d(4)}", f"0044 (0)1632 960 {d(3)}", f"020 7946 0{d(3)}", f"{d(3)} 555 0{d(3)}"])
            return base + (f" ext. {d(2)}" if r.random() < 0.2 else ""), "phone"
        if slot == "ssn":
            return r.choice([f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}"]), "id_number"
        if slot == "tax":
            return f"{d(2)} {d(3)} {d(3)} {d(3)}", "id_number"
        if slot == "dni":
            return d(8) + r.choice(["", "-"]) + r.choice("TRWAGMYF"), "id_number"
        if slot == "nie":
            return f"{r.choice('XYZ')}{d(7)}{r.choice('TRWAG')}", "id_number"
        if slot == "aad":
            return f"{d(4)} {d(4)} {d(4)}", "id_number"
        if slot == "other":
            return r.choice([f"QQ {d(2)} {d(2)} {d(2)} B", f"X{r.choice('ABC')}{d(7)}", f"{r.choice('KDWFM')}{d(3)}-{d(4)}-{d(4)}"]), "id_number"
        if slot == "ticket":
            return r.choice([f"555-{d(2)}-{d(4)}", f"555-{d(2)}-{d(5)}", f"2026-{d(2)}-{d(5)}"]), None
        if slot == "invoice":
            return r.choice([f"{d(4)}-{d(1)}-{d(5)}", f"{d(3)}-{d(2)}-{d(4)}"]), None
        if slot == "caseno":
            return f"{d(4)} {d(4)} {d(4)}", None
        if slot == "town":
            return f"{r.choice(_TOWNS)} {self.word(2)}".strip(), None
        if slot == "firm":
            return r.choice("Systems Group Partners Logistics Insurance Technologies Consulting Services Ltd Software Energy Health".split()), None
        if slot == "cap":
            return self.word(2), None
        if slot == "address":
            town, street = self.fill("town")[0], r.choice([self.word(1), self.word(2), f"Old {self.word(1)}", f"St. {self.word(1)}'s"])
            return r.choice([f"{d(3)} {street} {r.choice(['Street', 'Ave', 'Rd', 'St.', 'Court', 'Lane'])}, {town}, NM 0{d(4)}", f"{d(2)} {street} Avenue, Apt {d(2)}B, {town}", f"Flat 7, {d(2)} {street} Road, {town} QX5 9ZZ", f"{d(2)} rue des {self.word(2)}, 0{d(4)} {town}", f"{self.word(2)} Weg {d(2)}, 0{d(4)} {town}", f"P.O. Box {d(4)}, {town}", f"Via {self.word(2)} {d(2)}, 0{d(4)} {town}", f"Calle de la {self.word(2)} {d(1)}, 2{d(4)} {town}"]), "address"
        if slot == "day":
            return r.choice("Monday Tuesday Wednesday Thursday Friday".split()), None
        return first.lower(), None


def generated(n: int = SAMPLE, seed: int = 11) -> tuple[list[tuple[str, set[tuple[int, int, str]]]], Lexicon]:
    """``n`` texts of one to four sentences with their labels, and the lexicon that goes with them."""
    r = random.Random(seed)
    maker = _Maker(r)
    patterns, out = [p.strip("\n") for p in PATTERNS.split(";") if p.strip()], []
    for _ in range(n):
        text, labels = "", set()
        for _ in range(r.randint(1, 4)):
            if text:
                text += r.choice(["\n", "\n\n", " ", "\n> "]) if text[-1] in ".?!" else "\n"
            for piece in re.split(r"(\{\w+\})", r.choice(patterns)):
                if piece.startswith("{"):
                    value, kind = maker.fill(piece[1:-1])
                    if kind:
                        labels.add((len(text), len(text) + len(value), kind))
                    text += value
                else:
                    text += piece
        out.append((text, labels))
    return out, maker.lexicon


def _lattice(text: str, found: list, labels: set) -> tuple[list, list[int], list[dict[int, str]], list[bool]]:
    """Candidates by their ends, for each the number that end before it begins and its neighbours with the feature of the pair, and which are labels."""
    found = sorted({(a, b, k): (a, b, k, f) for a, b, k, f in found}.values(), key=lambda c: (c[1], c[0]))
    ends = [c[1] for c in found]
    before, near = [], []
    for i, c in enumerate(found):
        j = i
        while j and ends[j - 1] > c[0]:
            j -= 1
        before.append(j)
        near.append({k: pair_of(text, found[k], c) for k in range(j) if ends[k] >= c[0] - NEAR})
    return found, before, near, [(a, b, k) in labels or k == "link" for a, b, k, _ in found]


def _add(x: float, y: float) -> float:
    top = max(x, y)
    return top + math.log(math.exp(x - top) + math.exp(y - top))


def likelihood(lattice, weights: dict[str, float]) -> tuple[float, dict[str, float]]:
    """Log likelihood of the labels, as far as they are candidates, and its gradient, by the forward recursion over segments and its reverse."""
    found, before, near, gold = lattice
    score = [sum(weights[f] for f in c[3]) for c in found]
    pair = lambda j, i: weights[near[i][j]]
    prefix, inner, chain = [0.0], [], []
    for i in range(len(found)):
        top = prefix[before[i]]
        total = 1.0 + sum(math.exp(chain[a] - top) * (math.exp(pair(a, i)) - 1) for a in near[i])
        inner.append(top + math.log(max(total, 1e-12)))
        chain.append(score[i] + inner[i])
        prefix.append(_add(prefix[-1], chain[i]))
    grad: dict[str, float] = defaultdict(float)
    d_prefix, d_chain = [0.0] * (len(found) + 1), [0.0] * len(found)
    d_prefix[-1] = 1.0
    for i in range(len(found) - 1, -1, -1):
        w = math.exp(chain[i] - prefix[i + 1])
        d_chain[i] += d_prefix[i + 1] * w
        d_prefix[i] += d_prefix[i + 1] * (1 - w)
        p = d_chain[i]
        for f in found[i][3]:
            grad[f] -= p
        rest = p * math.exp(prefix[before[i]] - inner[i])
        for a in near[i]:
            e, t = math.exp(chain[a] - inner[i]), math.exp(pair(a, i))
            d_chain[a] += p * e * (t - 1)
            grad[near[i][a]] -= p * e * t
        d_prefix[before[i]] += rest
    value, last = -prefix[-1], None
    for i, told in enumerate(gold):
        if told and (last is None or found[last][1] <= found[i][0]):
            value += score[i]
            for f in found[i][3]:
                grad[f] += 1
            if last is not None and last in near[i]:
                value += pair(last, i)
                grad[near[i][last]] += 1
            last = i
    return value, grad


def train(texts, lexicon: Lexicon, rounds: int = 8, step: float = 0.25, ridge: float = 2e-5, seed: int = 3) -> dict[str, float]:
    """Weights of greatest penalised likelihood, by steps along the gradient of one text after the other, scaled by feature."""
    classes = Field({}, lexicon).classes
    lattices = [_lattice(text, candidates(text, classes), labels) for text, labels in texts]
    weights, squares, r = defaultdict(float), defaultdict(lambda: 1e-6), random.Random(seed)
    for _ in range(rounds):
        r.shuffle(lattices)
        for lattice in lattices:
            for f, g in likelihood(lattice, weights)[1].items():
                g -= ridge * weights[f]
                squares[f] += g * g
                weights[f] += step * g / math.sqrt(squares[f])
    return {f: round(w, 3) for f, w in sorted(weights.items()) if abs(w) > 5e-3}


def accuracy(field: Field, texts: list[tuple[str, set[tuple[int, int, str]]]]) -> dict[str, tuple[float, float]]:
    """Precision and recall of exact spans by kind."""
    out = {}
    for kind in KINDS:
        hits = told = true = 0
        for text, labels in texts:
            got, want = {s for s in field.spans(text) if s[2] == kind}, {s for s in labels if s[2] == kind}
            hits, told, true = hits + len(got & want), told + len(got), true + len(want)
        out[kind] = (round(hits / max(told, 1), 4), round(hits / max(true, 1), 4))
    return out


if __name__ == "__main__":
    sample, known = generated()
    learned = train(sample, known)
    WEIGHTS.write_text(json.dumps(learned, ensure_ascii=False, indent=0) + "\n")
    others, lexicon_of_others = generated(1500, seed=97)
    print(len(learned), accuracy(Field(learned, lexicon_of_others), others), accuracy(Field(learned), others))
