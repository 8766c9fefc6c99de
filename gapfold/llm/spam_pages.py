"""The labelled sample of the spam model: made-up commits whose every line has a
known state.

Words are made of syllables of several scripts, so that no word means anything and
none can be learnt; a page draws its words from a small vocabulary of its own.
Honest pages hold prose, code, tables, short lists and links that serve them; spam
pages hold keyword lines, link lists, tag lists and menus below a short message.

`python -m gapfold.llm.spam_pages` prints the model counted on the sample.
"""

from __future__ import annotations

import random
import textwrap

from gapfold.llm import spam

# Syllables to make words of, by script.
SYLLABLES = {
    "latin": "ba ce di fo gu la me ni por tas ver lin sto ra que mi".split(),
    "accents": "é dä ñi çu lö rê pa ti mo sel gra un".split(),
    "cyrillic": "ба ве ги до жу ка ле ми но пра сту ча ры".split(),
    "greek": "βα γε δι κο λυ με νι πρα στο ρη".split(),
    "hindi": "का मे नि गो पुर ला सि दे रा तो".split(),
    "arabic": "با تي سو در كل مان ور ين فا".split(),
    "han": list("山水火木金土日月人口手目耳足車門雨風花草"),
    "kana": "か さ た な は ま や ら わ き し ち に ひ み り".split(),
}
TRAINED, HELD_OUT = ("latin", "accents", "cyrillic", "han"), ("greek", "hindi", "arabic", "kana")
PROSE, LINKS, TAGS, MENU = range(4)


class Writer:
    """Lines of one page in one script."""

    def __init__(self, rng: random.Random, script: str):
        self.rng, self.script = rng, script
        self.joined = script in ("han", "kana")
        self.words = [self._word(rng.randint(2, 4)) for _ in range(300)]
        self.small = [self._word(1) for _ in range(9)]
        self.things = [" ".join(self._word(rng.randint(2, 3)) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 9))]
        self.lures = [self._word(rng.randint(2, 3)) for _ in range(rng.randint(4, 9))]

    def _word(self, n: int) -> str:
        return "".join(self.rng.choice(SYLLABLES[self.script]) for _ in range(n))

    def word(self) -> str:
        return self.words[min(int(self.rng.expovariate(0.02)), len(self.words) - 1)]

    def sentence(self) -> str:
        w = [self.rng.choice(self.small) if self.rng.random() < 0.35 else self.word() for _ in range(self.rng.randint(5, 14))]
        return ("" if self.joined else " ").join(w).capitalize() + ("。" if self.joined else ".")

    def name(self) -> str:
        return "".join(self.rng.choice(SYLLABLES["latin"]) for _ in range(self.rng.randint(2, 4)))

    def url(self) -> str:
        return f"https://{self.name()}{self.rng.randrange(99)}.example/{self.name()}-{self.name()}"

    def code(self) -> str:
        a, b, c = self.name(), self.name(), self.rng.randrange(99)
        return self.rng.choice([f"    {a} = {b}({c}, {a})", f"if ({a} > {c}) {{", f"  return {a}.{b}({c});", f'  "{a}": "{b}",', f"import {a}.{b}", f".{a} {{ margin: {c}px; }}", f"def {a}({b}):", f"{a}_{b}", f"src/{a}/{b}.py"])

    def keywords(self) -> str:
        return " ".join(self.rng.choice((f"{self.rng.choice(self.lures)} {self.rng.choice(self.things)}", f"{self.rng.choice(self.things)} {self.rng.choice(self.lures)}")) for _ in range(self.rng.randint(3, 6)))

    def stuffed(self) -> list[str]:
        """A paragraph of sentences around one thing, wrapped."""
        thing, r = self.rng.choice(self.things), self.rng
        small = [self.rng.choice(self.small) for _ in range(6)]
        forms = [f"{small[0]} {small[1]} {{x}}, {small[2]} {{x}} {small[3]} {{y}} {{x}}.", f"{{x}}? {small[4]}, {{x}}!", f"{small[1]} {{x}} {small[5]}, {{x}} {small[2]}.", f"{{y}} {{x}} {small[0]} {{y}} {{x}}"]
        text = " ".join(r.choice(forms).format(x=r.choice((thing, f"{r.choice(self.lures)} {thing}")), y=r.choice(self.lures)) for _ in range(r.randint(8, 30)))
        return textwrap.wrap(text, r.choice((70, 80, 100)))

    def tag(self) -> str:
        t = "".join(w.title() for w in self.rng.choice(self.things).split()) + self.rng.choice(["", self.rng.choice(self.lures).title(), str(self.rng.randrange(99))])
        return self.rng.choice(["#", "@", "#"]) + t

    def honest(self) -> list[tuple[str, int]]:
        r, out = self.rng, []
        out.append(" ".join(self.word() for _ in range(r.randint(1, 4))))
        for _ in range(r.randint(0, 3)):
            out += r.choice((
                lambda: [self.sentence() for _ in range(r.randint(1, 5))],
                lambda: [self.code() for _ in range(r.randint(2, 14))],
                lambda: [self.code() for _ in range(r.randint(2, 14))],
                lambda: [f"- [{self.word()}]({self.url()}): {self.sentence()}" for _ in range(r.randint(2, 8))],
                lambda: [self.sentence(), self.url(), self.sentence()],
                lambda: ["# " + self.word(), f"curl {self.url()}", "# " + self.word()],
                lambda: [f"See {self.url()}"],
                lambda: [f"[{self.word()}]: {self.url()}" for _ in range(r.randint(1, 6))],
                lambda: [f"| {self.word()} | {self.word()} | {r.randrange(99)} |" for _ in range(r.randint(2, 6))],
                lambda: ["- " + " ".join(self.word() for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 8))]))()
        return [(x, PROSE) for x in out]

    def spam(self) -> list[tuple[str, int]]:
        r, n = self.rng, self.rng.randint(6, 25)
        head = [(" ".join(self.word() for _ in range(r.randint(1, 3))), PROSE)]
        wrap = r.choice(["{}", "{}", "/* {} */", "# {}", "<p>{}</p>"])
        sep = r.choice([" | ", ", ", " • ", " ★ ", "; "])
        return head + r.choice((
            lambda: [(wrap.format(self.keywords()), TAGS) for _ in range(n)],
            lambda: [(wrap.format(x), TAGS) for x in self.stuffed()],
            lambda: [(self.url(), LINKS) for _ in range(n)],
            lambda: [(r.choice((self.url(), f"{self.url()} {r.choice(self.things)}", f"{r.choice(self.things)} {r.choice(self.lures)}", f"{r.choice(self.things)} {r.choice(self.lures)} {self.url()} {r.choice(self.things)} {r.choice(self.lures)} {r.choice(self.things)}")), LINKS) for _ in range(n)],
            lambda: [(r.choice((self.url(), f"{self.url()} {self.word()} {self.word()}", " ".join(self.word() for _ in range(r.randint(1, 6))), f"{r.choice(self.lures)} {r.choice(self.things)}")), LINKS) for _ in range(n)],
            lambda: [(f"- [{r.choice(self.lures)} {r.choice(self.things)}]({self.url()})", LINKS) for _ in range(n)],
            lambda: [(f'<a href="{self.url()}">{r.choice(self.things)} {r.choice(self.lures)}</a><br>', LINKS) for _ in range(n)],
            lambda: [(sep.join(self.tag() for _ in range(r.randint(2, 6))) if "#" not in sep else self.tag(), TAGS) for _ in range(n)],
            lambda: [(sep.join(f"{r.choice(self.lures)} {r.choice(self.things)}" for _ in range(r.randint(3, 6))), MENU) for _ in range(n)]))()


def page(rng: random.Random, scripts: tuple[str, ...], spam_page: bool) -> list[tuple[str, int]]:
    """The lines of a page with their states."""
    w = Writer(rng, rng.choice(scripts))
    return w.spam() if spam_page else w.honest()


def sequence(lines: list[tuple[str, int]]) -> tuple[str, list[int]]:
    """Symbols and states of a page's lines with words, as the model sees them."""
    marks = spam.line_symbols([x for x, _ in lines])
    kept = [(s, z, -(-n // spam.PART_WORDS)) for (s, n), (_, z) in zip(marks, lines) if s]
    return "".join(s * k for s, _, k in kept), [z for _, z, k in kept for _ in range(k)]


def learn(pages: int = spam.PAGES, seed: int = 0, scripts: tuple[str, ...] = TRAINED) -> spam.Model:
    """The model counted on `pages` made-up pages, one in ten of them spam."""
    rng = random.Random(seed)
    return spam.Model.counted([sequence(page(rng, scripts, i % 10 == 0)) for i in range(pages)])


def main() -> None:
    m = learn()
    for name, v in (("FIRST", m.first), ("MOVE", m.move), ("EMIT", m.emit)):
        print(f"{name} = {v.round(6).tolist()}")


if __name__ == "__main__":
    main()
