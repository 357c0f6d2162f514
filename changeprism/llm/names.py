"""Variant spellings of people and organisations linked to one entity.

Every distinct identity (name, mail address, login, repository) is read into tokens: family name, given name under its
full form, organisation, login. Identities whose address spells the family name, or that have a login, are the
references; their organisation, family and given name or their login name an entity. Every identity, references
included, reaches an entity only through one prefix-filtered set-similarity join on the q-grams of its tokens, inside
blocks that share a clue (organisation, login, address; for identities without any of them the repository or the given
name): grams are ordered by document frequency, and pairs of the rarest grams are the join keys. What the join finds is
verified by a soft weighted token similarity, in which each token weighs its inverse relative frequency, near-equal
tokens count in part and an exchange of neighbours is one error. The best verified entity wins if no other is as good;
else the identity stands for itself, under a name that no reference has, its address or its login. An address that one
person alone can have leads to the only entity that has it, decides between entities that are as good, and identities of
one address are one.

Hosts where anyone may have an address are found in the data: their people are at home in many other organisations.

Defined results: null or empty names and addresses match by what is left; an identity without family name, login and
address is nobody's; an address that many may have (no host, a local one or a machine's, no user part) counts with the name only;
rows of one entity are linked in all repositories; a row is never linked to itself; repeated ids give one link.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeprism.session import cut_lineage

#: Full given names, each with forms in use (well-known English, German, French, Spanish, Polish, Russian and
#: Scandinavian short forms and equivalents; a parameter of identities()).
GIVEN = """
agnieszka: aga agi agnes agniesza
aleksandra: sandra ola alexandra olka lexi
alexander: sasha alex xander lex sandro alec alejandro
anais: ana annie nais anna ann anne
andrew: andy drew andreas andre andrzej
anthony: tony anton antoni antonio
antonia: tona nia toni tonia
augustin: gus august austin auggie gustl
barbara: barb babs basia
bartholomew: barty tolly bart bartek
benjamin: benji benny ben benno
bjoern: bjarne bjorn
carolina: caro karolina caroline carol
charles: charlie chuck karl carlos
christina: tina kristina chrissy
christopher: chris topher kit christoph
cordelia: delia cordy cora
daniel: dan danny
david: dave davy
deborah: debbie deb
dmitri: dima dim mitya dmitry dmitrij
dorothea: dot dottie dorothy
edmund: eddie ned ed ted eddy
elisabeth: liz beth lisa elizabeth elsa lisbeth betty eliza lizzie lisi
francois: fanch franck fran frans francis frank francisco franz
frederike: rike fritzi freddy frieda frederika fred freddie riki
gabriel: gabi gabe gab gabriele
george: georgie georg jorge jerzy
gregory: greg gregor grzegorz
guadalupe: pita lupe lupita
guenther: gunni gunther gunter gunnar guenter
henry: hank harry heinrich henri
ignacio: iggy nacho ignaz ignatius
james: jim jimmy jamie
jennifer: jen jenn
johanna: hanni jo hanna johanne joanna hanne
john: jack johann juan ivan jan
jonathan: jon nathan jonny johnny
jozef: jozek jozi joe josef joseph jose pepe
katharina: kathi kate katja katharine kat kathy kathrin catherine katie katya
kenneth: ken kenny
konstantin: kostya costa kon konsti constantine konstantine
leonard: lenny leo len leon
lawrence: larry laurent lars
magdalena: lena magda leni madeleine maggi
margarete: rita greta maggie margaret grete margot marga meg peggy gretchen
maria: mary mia marie mariam
mateusz: mat matty mateo mati matthew matt
michael: mike mick michi mikey micha mischa miguel mikhail
nikolaus: nico klaus nik nick nicholas niko claus nicolas
ottilie: odi tilly otti otilie odile
pamela: pam pammy
patricia: pat patty tricia
peter: pete pedro pierre piotr
penelope: pen penny nell poppy
philip: phil felipe philippe
raphael: raph rafa rafael raffi
rebecca: becky becca
richard: dick rick richie ricardo
robert: bert bob rob bobby robbie
samuel: sam sammy samu
soeren: soren sonny
stephen: steve steven stefan esteban
susan: sue susie suzanne
theodora: thea dora teddy teodora theo
thomas: tom tommy tomas tomasz
timothy: tim timmy
vera: vee verka veronika
victoria: vicky tori
walter: walt wally
wilhelmina: willa billie mina minnie helma wilma
william: bill liam will billy willy wim
yevgenia: zhenya eugenia jenny evgenia genia evgeniya
zoe: zo zozo zoey
"""
#: Public providers of mail boxes; others are found in the data. A parameter of identities().
FREE_HOSTS = ("gmail", "googlemail", "outlook", "hotmail", "yahoo", "gmx", "web", "proton", "protonmail", "icloud", "mail")
#: Other organisations of its people from which on a host is taken for a provider, and their least share (a power of its people).
MANY_HOMES, HOMES_POWER = 5, 0.5
ROLES = {"team", "dev", "devs", "engineering", "eng", "oss", "build", "code", "ops", "info", "admin", "bot", "ci", "release", "releases", "opensource", "github", "hq", "support", "it", "root", "hello", "contact"}
LEGAL = {"inc", "ltd", "gmbh", "corp", "corporation", "llc", "ag", "sa", "co", "company", "systems", "software", "technologies", "technology", "tech", "laboratories", "labs", "lab", "consulting", "team", "the", "group", "solutions", "limited"}
#: Q-gram length, least Jaccard similarity of the prefix filter, least soft weighted similarity, weight of a given name.
Q, JACCARD, SOFT, GIVEN_WEIGHT = 2, 0.4, 0.86, 2.0
#: Most typing errors in a family name where only the given name is shared.
FAR_ERRORS = 1


def fold(s: str | None) -> str:
    """Lower case, accents written out or dropped."""
    s = (s or "").lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ø", "oe"), ("å", "aa"), ("ß", "ss"), ("æ", "ae"), ("ł", "l")):
        s = s.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


class Reader:
    """Tokens of an identity."""

    def __init__(self, given: str = GIVEN, free_hosts: tuple[str, ...] = FREE_HOSTS):
        self.full: dict[str, str] = {}
        for line in given.strip().splitlines():
            names = line.replace(":", " ").split()
            for n in names:
                self.full.setdefault(n, names[0])
        self.known = sorted(self.full, key=len, reverse=True)
        self.free = set(free_hosts)

    def near(self, w: str) -> str | None:
        """The full form of a given name, one typing error allowed in longer ones."""
        if w in self.full:
            return self.full[w]
        if len(w) < 5:
            return None
        hits = {self.full[k] for k in self.full if len(k) > 4 and abs(len(k) - len(w)) < 2 and one_error(k, w)}
        return hits.pop() if len(hits) == 1 else None

    def host(self, email: str) -> tuple[str, str]:
        """(organisation or '', kind): kind is org, free, noreply or ''."""
        _, at, host = email.rpartition("@")
        labels = [x for x in host.split(".") if x]
        if not at or len(labels) < 2:
            return "", ""
        if "noreply" in host:
            return "", "noreply"
        own = labels[-2]
        if "-" in own and own.rpartition("-")[2] in ("laptop", "desktop", "pc", "mac", "macbook", "mbp", "imac", "home", "ws", "box", "notebook", "thinkpad"):
            return own.rpartition("-")[0], "own"  # a machine named after its owner
        return ("", "free") if own in self.free or own in ("localdomain", "local", "localhost") or labels[-1] in ("local", "lan", "internal", "localdomain") else (own, "org")

    def local(self, local: str) -> tuple[str, str, str]:
        """(given or '', initial or '', family or '') of the user part of an address or of a login."""
        s = re.sub(r"\d+$", "", local)
        parts = [p for p in re.split(r"[._\-]+", s) if p]
        if len(parts) >= 2:
            a, b = parts[0], parts[-1]
            if len(b) == 1:
                return "", b, a
            if len(a) == 1:
                return "", a, b
            if self.near(a):
                return self.near(a), "", b
            if self.near(b):
                return self.near(b), "", a
            return "", "", b
        s = re.sub(r"dev$", "", parts[0]) if parts else ""
        for k in self.known:
            if len(k) > 2 and s.startswith(k) and len(s) - len(k) >= 4:
                return self.full[k], "", s[len(k) :]
        return "", "", s

    def name(self, name: str | None) -> tuple[str, str, str, list[str]]:
        """(given, initial, family, all words) of a written name."""
        raw = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name or "").strip()
        raw = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", raw) if " " not in raw else raw
        comma = "," in raw
        words = [w for w in re.findall(r"[a-z]+", fold(raw).replace("'", ""))]
        long = [w for w in words if len(w) > 1]
        first = [w for w in words if len(w) == 1]
        givens = [(i, self.near(w)) for i, w in enumerate(long) if self.near(w)]
        if givens and len(long) > 1:
            # of two readable as given names the exact one, then the first (the last after a comma)
            i, g = sorted(givens, key=lambda x: (long[x[0]] not in self.full, -x[0] if comma else x[0]))[0]
            rest = [w for k, w in enumerate(long) if k != i]
            return g, "", rest[-1] if i == 0 else rest[0], words
        if len(long) == 1:
            w = long[0]
            if first:
                return "", first[0], w, words
            if self.near(w):
                return self.near(w), "", "", words
            return "", "", "", words
        return "", "", long[-1] if long else "", words

    def address(self, email: str, local: str, kind: str, words: list[str]) -> str:
        """What an address is known by: itself, with the name where many may have it; '' if there is neither."""
        labels = email.rpartition("@")[2].split(".")
        if local and kind in ("org", "free", "noreply") and not {labels[0], labels[-1], labels[-2]} & {"localhost", "localdomain", "local", "lan", "internal"}:
            return email
        return f"\t{email} {' '.join(words)}" if email and words else ""  # a blank that no trimmed address begins with

    def read(self, name: str | None, email: str | None, login: str | None) -> dict[str, str]:
        typed, email, login = (email or "").strip().lower(), fold(email).strip(), fold(login).strip().lstrip("@")
        org, kind = self.host(email)
        local = email.rpartition("@")[0]
        if kind == "noreply":
            local = local.partition("+")[2] if "+" in local else "" if local in ("noreply", "no-reply") else local
            login = login or local
        given, initial, family, words = self.name(name)
        machine = email.rpartition("@")[2].split(".")[0]
        if org and machine in ("localhost", "local"):
            login, local, org = login or local, "", ""  # an account on some machine
        if not login and re.fullmatch(r"@?[a-z]{5,}\d*", (name or "").strip()):
            login = fold(name).strip().lstrip("@")  # a login in place of a name
        if kind == "own":
            local, org = (f"{local}.{org}" if self.near(local) and not self.near(org) else local), ""
        base = local.partition("+")[0] if kind != "noreply" else local
        address = self.address(typed, local, kind, words)
        shown = "".join(w for w in words if w not in LEGAL)
        # an account of an organisation
        tail = re.sub(r"[^a-z]", "", login)
        if org and (base in ROLES or (shown and shown == org)):
            return {"org": org, "role": "1", "login": login}
        # 'nick-organisation' and 'organisation-suffix' logins
        pieces = re.split(r"[._\-]+", login)
        at_login = ""
        if len(pieces) == 2:
            if not org and pieces[1] in ROLES and not self.near(pieces[0]):
                return {"org": pieces[0], "role": "1", "login": login}
            if self.near(pieces[0]) and family and not one_error(pieces[1], family) and pieces[1] != family and len(pieces[1]) > 8:
                at_login = pieces[1]
        if not org and tail.endswith("hq") and shown and one_error(tail[:-2], shown):
            return {"org": tail[:-2], "role": "1", "login": login}
        g2, i2, f2 = self.local(base) if base and base not in ROLES else ("", "", "")
        if kind == "noreply" and at_login:
            f2 = ""
        if family and len(base) == len(family) + 1 and base.endswith(family):
            g2, i2, f2 = "", base[0], family  # an initial and the family name, whatever else may be read into it
        # the initial before or the letters after a family name in short user parts
        guess = ""
        if f2 and not g2 and not i2 and not re.fullmatch(r"(?:ws|pc|host|desk)\d+", machine):
            guess = "" if family else "1"
            f2, i2 = _shorten(f2, family)
        if not family and f2 and words and not given:
            given, initial = g2, i2
        fam = f2 if f2 and (not family or kind in ("org", "free", "own") or one_error(f2, family)) else family
        if family and f2 and fam == f2 and kind == "org" and not given and not initial and not g2 and not i2:
            i2 = f2[:1] if f2[1:] == family else ""
        out = {"given": g2 or given if given == "" or g2 == "" or g2 == given else given, "initial": (g2 or given or i2 or initial)[:1], "family": fam, "org": org or at_login, "work": at_login, "login": login, "role": "", "address": address, "typed": "" if f2 and fam == f2 else "1", "guess": guess if fam == f2 else ""}
        return out


def _shorten(user: str, family: str) -> tuple[str, str]:
    """(family, initial) of 'gfamily', 'familygi' and the like, with the written family name as a guide if there is one."""
    if family:
        if user == family or one_error(user, family) and len(user) == len(family):
            return user, ""
        if len(family) > 3 and user.endswith(family):
            return family, user[:1]
        if len(family) > 3 and user.startswith(family):
            return family, user[len(family) : len(family) + 1]
        for cut, ini in ((user[1:], user[:1]), (user[:-2], user[-2:-1]), (user[:-1], user[-1:])):
            if len(cut) > 3 and (cut == family or one_error(cut, family)):
                return cut, ini
        return user, ""
    return user[1:], user[:1]


def one_error(a: str, b: str) -> bool:
    """Whether two words differ by at most one insertion, omission, substitution or exchange of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


_FIELDS = ("given", "initial", "family", "org", "work", "login", "role", "address", "typed", "guess")


def identities(rows: DataFrame) -> DataFrame:
    """``rows`` (name, email, login and any others) with the tokens of each identity; '' where there is none."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"{f} string" for f in _FIELDS)]).replace("`login`", "`login_as_typed`")
    keep = [f.name for f in rows.schema.fields]
    names = ["login_as_typed" if k == "login" else k for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(), {}
        for batch in batches:
            cols = {f: [] for f in _FIELDS}
            for key in zip(batch.column("name").to_pylist(), batch.column("email").to_pylist(), batch.column("login").to_pylist(), strict=True):
                t = seen.get(key)
                if t is None:
                    if len(seen) > 200_000:
                        seen.clear()
                    t = seen[key] = reader.read(*key)
                for f in _FIELDS:
                    cols[f].append(t.get(f, ""))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(cols[f], pa.string()) for f in _FIELDS)], [*names, *_FIELDS])

    return rows.mapInArrow(run, schema)


def _grams(c: Column) -> Column:
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (Q - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(Q))))


def similar_tokens(left: DataFrame, right: DataFrame, least: float = JACCARD) -> DataFrame:
    """(block, a, b): distinct tokens of ``left`` and ``right`` (block, token) of one block with q-gram Jaccard >= ``least``,
    which is a third at least; where ``left`` says so (exact boolean, if it has that column) with the same grams only.

    Prefix filter: with grams in one global order, two sets of that similarity that share two grams (all that are similar
    do; a token has two at least) share two among the first |s| - ceil(least |s|) + 2 of each, two equal sets the first two.
    The pairs of those, rarest grams first, are the join keys: one for an exact token and for tokens of blocks in which all
    are exact. They are made once for each token of the vocabulary and not for each block.
    """
    asked = left.select(F.lit(False).alias("given"), "block", "token", (F.col("exact") if "exact" in left.columns else F.lit(False)).alias("exact"))
    tokens = cut_lineage(asked.unionByName(right.select(F.lit(True).alias("given"), "block", "token", F.lit(False).alias("exact"))).distinct())  # read seven times below
    asked, given = tokens.where("NOT given").select("block", F.col("token").alias("a"), "exact"), tokens.where("given").select("block", F.col("token").alias("b"))
    words = tokens.select("token").distinct().withColumn("gram", F.explode(_grams(F.col("token"))))
    # at most |alphabet|**Q rows
    rank = words.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = words.join(rank, "gram").groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"]).alias("g"))
    size = F.size("g")
    prefix = F.slice("g", F.lit(1), (size - F.ceil(F.lit(least) * size) + 2).cast("int"))
    pairs = F.flatten(F.transform(F.col("p"), lambda x: F.transform(F.filter(F.col("p"), lambda y: y > x), lambda y: F.concat(x, y))))
    first = F.concat(F.least(F.col("g")[0], F.col("g")[1]), F.greatest(F.col("g")[0], F.col("g")[1]))
    vocabulary = ranked.select("token", size.alias("size"), first.alias("first"), prefix.alias("p")).select("token", "size", "first", pairs.alias("keys"))
    near = asked.where(~F.col("exact")).select("block").distinct().withColumn("near", F.lit(True))
    keys = lambda one: F.explode(F.when(one, F.array("first")).otherwise(F.col("keys"))).alias("key")
    x = asked.join(vocabulary.withColumnRenamed("token", "a"), "a").select("block", "a", "exact", F.col("size").alias("sa"), keys(F.col("exact")))
    y = given.join(near, "block", "left").join(vocabulary.withColumnRenamed("token", "b"), "b").select("block", "b", F.col("size").alias("sb"), keys(F.col("near").isNull()))
    fit = F.least("sa", "sb") >= F.lit(least) * F.greatest("sa", "sb")
    found = x.join(y, ["block", "key"]).where(F.when(F.col("exact"), F.col("a") == F.col("b")).otherwise(fit)).select("block", "a", "b", "sa", "sb").distinct()
    both = F.size(F.array_intersect(_grams(F.col("a")), _grams(F.col("b"))))
    return found.where((F.col("a") == F.col("b")) | (both >= F.lit(least) * (F.col("sa") + F.col("sb") - both))).select("block", "a", "b")


def errors(a: Column, b: Column) -> Column:
    """The Levenshtein distance; one exchange of neighbours is one error."""
    steps = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    swapped = F.exists(steps, lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    n = F.levenshtein(a, b)
    return F.when((n == 2) & (F.length(a) == F.length(b)) & swapped, 1).otherwise(n)


def shared_hosts(ids: DataFrame) -> DataFrame:
    """(org): hosts whose people are at home in many other organisations; a person's home is the smallest of the hosts used."""
    seen = ids.where("role = '' AND org != '' AND family != '' AND given != ''").select("given", "family", "org").distinct()
    sized = seen.join(seen.groupBy("org").agg(F.count("*").alias("people")), "org")
    home = sized.groupBy("given", "family").agg(F.min(F.struct("people", "org")).alias("home"))
    away = F.when(F.col("home.org") != F.col("org"), F.col("home.org"))
    hosts = sized.join(home, ["given", "family"]).groupBy("org").agg(F.countDistinct(away).alias("homes"), F.max("people").alias("people"))
    return hosts.where(F.col("homes") >= F.greatest(F.lit(float(MANY_HOMES)), F.pow("people", F.lit(HOMES_POWER)))).select("org")


def _weight(n: Column, total: Column) -> Column:
    """Inverse relative frequency, so that thresholds hold at every size; one of 1000 is as rare as can be told."""
    return F.log(1.0 + F.least(total / n, F.lit(1000.0)))


def _keyed(people: DataFrame) -> DataFrame:
    """Persons with the key ``first`` of the entity that their own tokens name; null where they name none."""
    persons = people.where("role = '' AND (family != '' OR login != '' OR address != '')")
    # in one organisation a family name is completed by the only given name that fits (its initial, if there is one);
    # rows without both are groups of their own
    firm = [F.when((F.col("org") != "") & (F.col("family") != ""), F.col("org")).otherwise(F.concat(F.lit("\t"), "who")), F.col("family")]
    spelt, letter = F.when(F.col("given") != "", F.col("given")), F.coalesce(F.when(F.col("given") != "", F.substring("given", 1, 1)), F.col("initial"))
    whole, part = Window.partitionBy(*firm), Window.partitionBy(*firm, letter)
    only = lambda w: F.when(F.min(spelt).over(w) == F.max(spelt).over(w), F.min(spelt).over(w))
    persons = persons.withColumn("given", F.coalesce(spelt, F.when(F.col("initial") != "", only(part)).otherwise(only(whole)), F.lit("")))
    own = F.when((F.col("org") != "") & (F.col("family") != ""), F.concat_ws("|", F.lit("P"), "family", F.when(F.col("given") != "", F.col("given")).otherwise(F.col("initial")), "org"))
    persons = persons.withColumn("own", own)
    # a login belongs to one person
    by_login = persons.where("login != '' AND own IS NOT NULL").groupBy("login").agg(F.mode("own", deterministic=True).alias("by_login"))
    persons = persons.join(by_login, "login", "left").withColumn("first", F.coalesce("own", "by_login", F.when(F.col("login") != "", F.concat(F.lit("L|"), F.col("login")))))
    persons = cut_lineage(persons.drop("by_login"))
    # an entity known by its login only is the one of an organisation that has the same name and no other login
    has = persons.where("first IS NOT NULL AND family != '' AND given != ''").select("first", "family", "given", "login", "repo_id")
    logins = has.where(F.col("first").startswith("L|")).select(F.col("first").alias("by"), "family", "given", "repo_id").distinct()
    firm = has.where(F.col("first").startswith("P|"))
    free = firm.groupBy(F.col("first").alias("firm"), "family", "given").agg(F.max("login").alias("taken")).where("taken = ''").drop("taken")
    near = logins.join(firm.select(F.col("first").alias("firm"), "family", "given", "repo_id").distinct(), ["family", "given", "repo_id"]).select("by", "firm").distinct().withColumn("same", F.lit(1))
    cand = logins.select("by", "family", "given").distinct().join(free, ["family", "given"]).select("by", "firm").distinct().join(near, ["by", "firm"], "left").withColumn("same", F.coalesce("same", F.lit(0)))
    chosen = (
        cand.groupBy("by").agg(F.count("*").alias("n"), F.sum("same").alias("s"), F.max_by("firm", F.struct("same", "firm")).alias("firm"))
        .where("n = 1 OR s = 1").select(F.col("by").alias("first"), "firm")
    )
    persons = persons.join(chosen, "first", "left").withColumn("first", F.coalesce("firm", "first")).drop("firm")
    # an address leads to the only entity that has it; those of several are kept for ties
    holders = persons.where(F.col("first").isNotNull() & _alone()).select("address", F.col("first").alias("entity")).distinct()
    sole = holders.groupBy("address").agg(F.min("entity").alias("holder"), F.count("*").alias("n")).where("n = 1").drop("n")
    return persons.join(sole, "address", "left").withColumn("first", F.coalesce("first", "holder")).drop("holder")


def _alone() -> Column:
    """Whether one person alone can have the address."""
    return (F.col("address") != "") & ~F.col("address").startswith("\t")


def _tokens(loose: bool) -> Column:
    """array<struct<block, token, clue>>: what an identity is looked up by. The clue is what both sides share besides."""
    some = lambda on, kind, block, token: F.when(on, F.struct(F.concat(F.lit(kind), block).alias("block"), token.alias("token"), F.lit(kind).alias("clue")))
    family, login = F.col("family"), F.col("login")
    each = [
        some((F.col("org") != "") & (family != ""), "o", F.col("org"), family),
        some(login != "", "l", login, login),
        some(_alone(), "a", F.col("address"), F.col("address")),
    ]
    if loose:
        repository = F.col("own").isNull() & (family != "")
        # the given name in any repository: only what no address spells may be a typing error there
        each += [some(repository & F.col("repo_id").isNotNull(), "r", F.col("repo_id").cast("string"), family), some(repository & (F.col("given") != ""), "g", F.col("given"), family)]
    else:
        each += [some(family != "", "r", F.coalesce(F.col("repo_id").cast("string"), F.lit("")), family), some((family != "") & (F.col("given") != ""), "g", F.col("given"), family)]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def resolve(people: DataFrame) -> DataFrame:
    """``people`` (from identities(), with who, repo_id) with the entity of each row: (who, repo_id, entity)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ids = people.select("who", "repo_id", *(text(f).alias(f) for f in _FIELDS))
    ids = ids.join(shared_hosts(ids).withColumn("shared", F.lit(True)), "org", "left").withColumn("org", F.when(F.col("shared"), F.col("work")).otherwise(F.col("org"))).drop("shared", "work")
    ids = cut_lineage(ids)
    roles = ids.where("role = '1' AND org != ''").select("who", "repo_id", "org", F.lit("O").alias("block"))
    persons = cut_lineage(_keyed(ids))
    references = persons.where("first IS NOT NULL AND (typed = '' OR family = '')")
    # a login or an address under a name that nothing spells leads to the entity too, where no better way does
    weak = persons.where("first IS NOT NULL AND own IS NULL AND typed != '' AND family != ''")
    tokens = lambda df, on: df.select(F.explode(_tokens(False)).alias("t"), F.col("first").alias("entity"), "family", "given", "initial", F.lit(on).alias("weak")).select("t.*", "entity", F.col("family").alias("p_family"), F.col("given").alias("p_given"), F.col("initial").alias("p_initial"), "weak")
    right = tokens(references, False).unionByName(tokens(weak, True).where("clue IN ('l', 'a')")).distinct()
    left = persons.select("who", "repo_id", "first", "own", "family", "given", "initial", "typed", "guess", F.explode(_tokens(True)).alias("t")).select("*", "t.*").drop("t")
    # what an address spells, logins and addresses are no typing errors: there only the same grams will do (one key each)
    by_hand = (F.col("typed") == "1") & F.col("clue").isin("o", "r", "g")
    org = roles.select("block", F.col("org").alias("token"))
    asked = left.select("block", "token", (~by_hand).alias("exact")).unionByName(org.withColumn("exact", F.lit(True)))
    found = cut_lineage(similar_tokens(asked, right.select("block", "token").unionByName(org)))
    # by how many references a clue or a family name is shared
    total = references.agg(F.greatest(F.count("*"), F.lit(1000)).alias("total"))  # one row
    clues = right.where("clue IN ('o', 'l', 'a')").groupBy("block").agg(F.countDistinct("entity").alias("n")).crossJoin(total).select("block", _weight(F.col("n"), F.col("total")).alias("clue_weight"))
    rare = right.where("NOT weak AND p_family != ''").groupBy("p_family").agg(F.countDistinct("entity").alias("n")).crossJoin(total).select("p_family", _weight(F.col("n"), F.col("total")).alias("weight"))
    pairs = (
        left.join(found.withColumnRenamed("a", "token"), ["block", "token"])
        .where(by_hand | (F.col("token") == F.col("b")))
        .join(right.drop("clue").withColumnRenamed("token", "b"), ["block", "b"])
        .join(clues, "block", "left").join(rare, "p_family", "left")
    )
    spelt = (F.col("family") != "") & (F.col("p_family") != "") & (F.col("guess") == "")
    weight = F.when(spelt, F.coalesce("weight", F.lit(0.0))).otherwise(0.0)
    apart = errors(F.col("family"), F.col("p_family"))
    alike = 1.0 - apart / F.greatest(F.length("family"), F.length("p_family"), F.lit(1))
    given_alike = (
        F.when((F.col("given") != "") & (F.col("p_given") != ""), F.when(F.col("given") == F.col("p_given"), 1.0).otherwise(0.0))
        .when((F.col("initial") != "") & (F.col("p_initial") != ""), F.when(F.col("initial") == F.col("p_initial"), 0.9).otherwise(0.0))
        .otherwise(0.8)
    )
    clue = F.coalesce("clue_weight", F.lit(0.0))
    scored = (
        pairs.withColumn("score", F.when(F.col("weak"), SOFT).otherwise((weight * alike + GIVEN_WEIGHT * given_alike + clue) / (weight + GIVEN_WEIGHT + clue)))
        .where((F.col("score") >= SOFT) & ((given_alike > 0) | F.col("clue").isin("l", "a")) & ((F.col("clue") != "g") | (apart <= FAR_ERRORS)))
        .groupBy("who", "repo_id", "entity")
        .agg(
            F.max(F.coalesce(F.col("first") == F.col("entity"), F.lit(False)) & ~F.col("weak")).alias("mine"),
            F.max(((F.col("clue") == "a") & ~F.col("weak")).cast("int")).alias("holds"), F.max((F.col("clue").isin("o", "l", "r") & ~F.col("weak")).cast("int")).alias("local"), F.max("score").alias("score"),
        )
    )
    scored = cut_lineage(scored)  # short plans keep the driver small
    w = Window.partitionBy("who", "repo_id").orderBy(F.desc("mine"), F.desc("holds"), F.desc("local"), F.desc("score"), "entity")
    rival = F.lead(F.struct("mine", "holds", "local", "score")).over(w)
    best = scored.select("who", "repo_id", "entity", "mine", "holds", "local", "score", F.row_number().over(w).alias("at"), rival.alias("rival")).where("at = 1")
    # of entities that are as good none is taken
    taken = F.expr("mine OR rival IS NULL OR rival.holds < holds OR rival.local < local OR rival.score < score - 0.02")
    best = best.select(F.col("who").alias("w"), F.col("repo_id").alias("r"), F.when(taken, F.col("entity")).alias("entity"))
    won = persons.join(best, (F.col("who") == F.col("w")) & F.col("repo_id").eqNullSafe(F.col("r")), "left")
    won = won.join(references.where("given != ''").select("family", "given").distinct().withColumn("known", F.lit(True)), ["family", "given"], "left")
    itself = (
        F.when((F.col("family") != "") & (F.col("given") != "") & F.col("known").isNull(), F.concat_ws("|", F.lit("N"), "family", "given"))  # a name that no reference has
        .when(F.col("address") != "", F.concat(F.lit("E|"), F.col("address"))).when(F.col("family") != "", F.concat_ws("|", F.lit("M"), "family", "given", "initial")).otherwise(F.concat(F.lit("L|"), F.col("login")))
    )
    shared = F.when(_alone() & F.col("own").isNull(), F.col("address"))
    won = won.select("who", "repo_id", shared.alias("address"), "entity", itself.alias("itself"))
    # identities of one address are one: what most of them won, else the address itself
    common = won.where("address IS NOT NULL AND entity IS NOT NULL").groupBy("address").agg(F.mode("entity", deterministic=True).alias("common"))
    rest = won.join(common, "address", "left").select("who", "repo_id", F.coalesce("common", "entity", "itself").alias("entity")).where("entity IS NOT NULL")
    accounts = roles.join(found.where("block = 'O'"), (roles.block == found.block) & (F.col("org") == F.col("a"))).select("who", "repo_id", F.concat(F.lit("O|"), F.col("b")).alias("entity"))
    return accounts.unionByName(rest)


def members(developers: DataFrame, commits: DataFrame) -> DataFrame:
    """(side, id, repo_id, entity): the person or organisation of each developers row (side d), and of each commits row (c)
    whose address is no developer's in its repository."""
    clean = lambda c: F.lower(F.trim(F.col(c)))
    devs = developers.select(F.concat(F.lit("d"), F.col("id")).alias("who"), "id", "repo_id", "name", "email", F.col("github_login").alias("login"))
    known = devs.select("repo_id", clean("email").alias("email")).distinct()
    c = commits.select("id", "repo_id", F.col("author_name").alias("name"), clean("author_email").alias("email"))
    strange = c.join(known, ["repo_id", "email"], "left_anti").where("repo_id IS NOT NULL")
    # nulls are left out of the text under their names, so identities that differ have texts that differ
    keyed = strange.withColumn("who", F.concat(F.lit("c"), F.sha2(F.to_json(F.struct("repo_id", "name", "email")), 256)))
    unique = keyed.select("who", "repo_id", "name", "email").distinct().withColumn("login", F.lit(None).cast("string"))
    people = identities(devs.select("who", "repo_id", "name", "email", "login").distinct().unionByName(unique))
    entity = resolve(cut_lineage(people)).select("who", "entity").distinct()
    rows = devs.select(F.lit("d").alias("side"), "who", "id", "repo_id").unionByName(keyed.select(F.lit("c").alias("side"), "who", "id", "repo_id"))
    return rows.join(entity, "who").select("side", "id", "repo_id", "entity")


def linked(developers: DataFrame, commits: DataFrame) -> DataFrame:
    """(link_kind, left_id, right_id): rows of one person or organisation, as defined in the test data."""
    m = cut_lineage(members(developers, commits))
    d = m.where("side = 'd'").select("id", "repo_id", "entity").distinct()
    a, b = d.select("entity", F.col("id").alias("left_id")), d.select("entity", F.col("id").alias("right_id"))
    pairs = a.join(b, "entity").where("left_id < right_id").select(F.lit("developer_developer").alias("link_kind"), "left_id", "right_id")
    rows = m.where("side = 'c'").select(F.col("id").alias("left_id"), "repo_id", "entity")
    to = rows.join(d.withColumnRenamed("id", "right_id"), ["repo_id", "entity"]).select(F.lit("commit_developer").alias("link_kind"), "left_id", "right_id")
    return pairs.unionByName(to).distinct()
