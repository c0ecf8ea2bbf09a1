"""Word classes of the abuse grammar and the normaliser that maps a written token to them.

The lists are plain words of English, German, French and Spanish, folded to ASCII: common words of abuse, of groups of
people, of violence, and of the small words that tie them to a person. They mean nothing by themselves: only clauses
score. None is a phrase out of the texts that are to be searched.
"""

from __future__ import annotations

import re
import unicodedata

# classes are bits
_NAMES = """INSULT THING SLUR_ADJ YOU YOUR BE PAST FIRST VIOLENCE DIE BODY WEAPON GROUP DEGRADE EXCLUDE HOSTILE SELF PEOPLE NEGATION NOBODY REJECT HOPE
    FAVOUR SHUT MOUTH LIVE PRONOUN SEX_STRONG SEX_MID SEX_WEAK CLINICAL SPEECH END COMMA INITIAL KIN MUST NAME BENIGN_NEXT OPEN_QUOTE CLOSE_QUOTE THEM
    THIS ALL_OF FROM THE OURS LIKE DESPISE PREP FUNC HINT STARRED UNREAD SURE PHRASE DET MODAL LINK WHAT BEGIN STOP PLAIN""".split()
for _i, _name in enumerate(_NAMES):
    globals()[_name] = 1 << _i

_WORDS = {
    # nouns that are said of persons only
    INSULT: """idiot idiots moron morons bastard bastards asshole assholes arsehole arseholes cretin cretins imbecile imbeciles loser losers dumbass
        dumbasses dumbasss scumbag scumbags cunt cunts whore whores bitch bitches slut sluts dickhead dickheads prick pricks wanker wankers twat twats
        retard retards halfwit halfwits dimwit dimwits degenerate degenerates fool fools coward cowards motherfucker motherfuckers fucker fuckers shithead
        shitheads shitbag douchebag douchebags jackass jackasses blockhead numbskull nitwit simpleton lowlife lowlifes liar liars hypocrite bully
        failure failures psycho psychopath lunatic nutcase pervert perverts creep creeps tramp hag bimbo bonehead crybaby
        arschloch arschlocher vollidiot vollidioten idioten drecksack drecksacke dreckskerl hurensohn hurensohne hure huren wichser missgeburt trottel spast
        spasti schlampe schlampen fotze penner mistkerl depp deppen vollpfosten dummkopf schwachkopf versager feigling lugner nichtsnutz blodmann
        connard connards connasse connasses conne salaud salauds salope salopes encule encules abruti abrutis debile debiles pute putes batard batards
        andouille raclure cretine lache laches menteur menteuse minable minables couillon couillons bouffon
        idiota idiotas imbecil imbeciles cabron cabrones gilipollas pendejo pendejos puta putas maricon basura capullo zorra zorras hijueputa malnacido
        subnormal estupido estupida cobarde cobardes mentiroso inutil inutiles payaso desgraciado bastardo
        airhead asshat asswipe birdbrain bozo brat buffoon chump clod crackpot crook crooks deadbeat dipshit dipshits dolt doofus dork dullard dunce fathead fraud fuckface fuckwit fuckwits gobshite goon goons ignoramus jerk jerks jerkoff knobhead knucklehead meathead nincompoop ninny numpty oaf phony pillock pinhead plonker poser scoundrel sicko sickos skank skanks sleazebag sleazeball slob slag slimeball sociopath swindler thug thugs tosser tossers traitor traitors turd turds twerp weakling weirdo weirdos whiner wimp wimps wuss yob yobs heuchler luder miststuck schwachmat spinner volltrottel""",
    # things and animals that persons are called: they count only where a person is called so
    THING: """scum trash garbage pig pigs swine parasite parasites shit shits piece-of-shit vermin crap clown clowns filth dirt rubbish rat rats snake
        snakes dog dogs monkey monkeys donkey cockroach cockroaches animal animals monster monsters
        abschaum schwein schweine drecksau ratte ratten hund hunde affe affen esel dreck mull ungeziefer
        ordure ordures merde merdes pourriture con cons porc porcs chien chiens rat cochon cochons cafard
        mierda escoria cerdo cerdos perro perros rata burro animal
        maggot maggots slime dung toad toads vulture vultures cancer disgrace abomination joke""",
    SLUR_ADJ: """stupid worthless pathetic useless filthy ugly brainless goddamn fucking disgusting dirty rotten miserable damn damned bloody dumb vile
        repulsive spineless shameless despicable wretched fat nasty cowardly lousy
        verdammter verdammte verdammtes bloder blode blodes dreckiger dreckige dumme dummer dummes widerlicher widerliche erbarmlicher nutzloser fette fetter
        pauvre sale espece stupide petit gros grosse inutile lamentable pathetique debile
        pedazo maldito maldita asqueroso asquerosa puto sucio sucia repugnante patetico
        idiotic moronic retarded pitiful sickening revolting insufferable obnoxious hideous stinking smelly talentless clueless gutless heartless braindead deranged slutty creepy incompetent contemptible loathsome hirnlose hirnloser ekelhafte ekelhafter degoutant degoutante ridicule abjecte asquerosos ridiculo inmundo""",
    YOU: "you youre ya u thee du dich dir ihr euch bist tu te toi t vous eres ti tus usted ustedes vosotros seid",
    YOUR: "your yours yourself dein deine deinen deiner deinem deines euer eure ton ta tes votre vos tu",
    BE: "is are am was were be been being youre isnt arent ist sind bin bist seid war waren est es sont sois etes son eres sois era fue c'est",
    PAST: "was were war waren wurde wurden etait etaient fut furent era eran fue fueron had",
    FIRST: "i we ill well im gonna ich wir je nous on voy vamos voi id",
    VIOLENCE: """kill cut stab beat bleed smash break burn strangle murder punch hurt slit bash crush gut butcher rape choke skin bury throw slaughter
        shoot hang drown whip gas castrate hit kick hunt destroy torture rip tear knock kneecap behead lynch throttle
        schlag schlage schlagen umbringen bringe toten tote verprugeln verprugle abstechen steche erstechen brechen breche erschiessen aufschlitzen prugeln
        casser casse tuer tue tuerai frapper frappe bruler egorger buter bute cogner demonter crever etrangler massacrer saigner
        romper rompo matar mato mate quemar degollar reventar reviento apunalar golpear estrangular pegar
        slap stomp pound batter bludgeon mutilate dismember execute annihilate finish maim skewer""",
    DIE: """die dies rot rots suffer suffers burn burns hang hangs drown drowns bleed bleeds choke chokes perish killed shot hanged beaten burned whipped gassed stoned drowned slaughtered stabbed thrown castrated
        sterben stirb verrecken verreck brennen erschossen verprugelt crever creve crevez mourir pendu battu morir muerete mueras muerete muerte pudrete
        paliza beating""",
    BODY: """throat teeth bones skull neck head face guts jaw ribs nose legs arms knees brains eyes hair fingers kehle fresse gesicht zahne knochen kopf hals
        gorge dents gueule tronche tete os jambes cara huesos dientes cuello cabeza piernas
        spine tongue chest stomach windpipe wrists knee arm leg back""",
    WEAPON: "bullet bullets knife blade rope axe hammer messer kugel couteau balle cuchillo bala",
    HOSTILE: """fuck-you fuck-off piss-off screw-you get-lost go-to-hell rot-in-hell get-out-of shut-up hell verschwinde verschwindet verpiss hau-ab degage degagez casse-toi callate vete largate lárgate jodete chinga
        bugger-off sod-off get-stuffed eat-shit shove-it up-yours""",
    SELF: """kill-yourself hang-yourself drown-yourself shoot-yourself kill-yourselves bring-dich-um hang-dich-auf geh-sterben va-crever va-mourir suicide-toi pends-toi matate muerete
        go-die end-yourself off-yourself go-kill""",
    SHUT: "shut halt halts haltet ferme fermez cierra",
    MOUTH: "mouth trap gob piehole klappe maul fresse schnauze mund gueule bouche boca hocico",
    NOBODY: "nobody noone none niemand keiner personne nadie ninguno",
    REJECT: "want wants wanted like likes love loves miss misses missed need needs cry cries weep mourn mourns vermissen vermisst mag braucht will weinen pleurera regrettera aime veut manquera extranara quiere llorara",
    HOPE: "hope wish pray hoffe hoffentlich wunsche espere souhaite espero ojala",
    FAVOUR: "favor favour service gefallen",
    LIVE: "live alive exist breathe breathing leben existieren atmen vivre exister respirer vivir existir respirar allowed allow",
    GROUP: """immigrants immigrant migrants refugees refugee foreigners foreigner outsiders newcomers strangers women gays gay lesbians homosexuals
        jews muslims blacks gypsies arabs asians mexicans africans cripples christians hindus roma trans faggots fags niggers kikes transgenders latinos
        natives pakistanis chinese turks poles
        auslander fluchtlinge frauen schwule lesben juden zuwanderer einwanderer migranten muslime zigeuner turken behinderte asylanten
        etrangers refugies immigres migrants femmes juifs musulmans arabes homosexuels tziganes roms handicapes noirs
        inmigrantes extranjeros refugiados mujeres judios musulmanes gitanos negros homosexuales moros maricones discapacitados
        atheists catholics protestants buddhists sikhs russians indians italians feminists jew muslim arab gypsy lesbian homosexual migrant men girls mexican somalis syrians afghans kurds albanians romanians""",
    PEOPLE: "people clans clan folk tribe tribes leute gens gente families",
    FROM: "from aus de",
    ALL_OF: "all alle tous toutes todos todas those diese ces esos esas die les los las every",
    DEGRADE: """vermin rats rat animals subhuman subhumans filth parasites parasite plague thieves thief sick stupid cockroaches lice disease scum
        savages apes monkeys dogs breed poison inferior criminals rapists worthless smell trash garbage dumb pest kind brains murderers terrorists invaders swine
        pigs monsters freeloaders perverts backward primitive diseased
        ungeziefer ratten diebe pack abschaum dumm untermenschen parasiten tiere affen gesindel seuche dreck verbrecher schmarotzer kriminelle minderwertig
        vermine rats voleurs parasites peste betes stupides cafards sous-hommes nuisibles singes racaille sottes animaux chiens criminels violeurs inferieurs
        plaga ratas ladrones tontas tontos bestias basura cucarachas parasitos escoria inferiores animales monos criminales violadores
        cockroach beasts barbarians degenerates ungrateful uncivilized uncivilised unclean filthy evil disgusting dishonest predators pedophiles paedophiles thugs vultures maggots cancer infestation locusts lesser useless stinking smelly greedy abomination unnatural crooks beggars bestien faul dreckig wilde barbaren sauvages barbares sales salvajes sucios barbaros""",
    EXCLUDE: """driven locked deport deported exterminated exterminate wiped wipe eradicated eradicate get-rid rid burn kitchen servants slaves mercy whip hanged
        shot gassed caged expel expelled remove banned ban sterilised sterilized send round drive throw keep lock
        raus herd ausgerottet vergast verjagt weg abschieben abgeschoben erschossen vertreiben ausrotten vernichten einsperren
        dehors chasse chasser brulez expulsez expulser cuisine noyer pendez eliminer exterminer enfermer virer
        echarlos quemen cocina fuera expulsarlos matarlos exterminarlos palos echar expulsar eliminar encerrar
        purge purged cleansed slaughtered lynched castrated enslaved outlawed eliminated executed jailed imprisoned segregated evicted chased kicked""",
    MUST: "should must ought belong belongs deserve deserves gehoren gehort sollen sollten mussen mussten doivent devraient qu deben hay-que deberian que merecen merece merite meritent verdienen verdient let lets",
    THEM: "them their they sus leurs ihre ihnen sie ellos ellas eux",
    PRONOUN: "he she er sie il elle el ella",
    THIS: "this that dieser ce cet cette este ese look",
    KIN: "mother family kids children wife sister brother father son daughter friends parents mutter familie bruder vater mere famille frere pere madre familia hermano padre",
    NEGATION: "not never isnt arent wasnt dont doesnt nicht nie kein keine pas jamais ni no nunca without ohne sans sin",
    SEX_STRONG: """porn porno pornos pornography blowjob blowjobs dildo dildos vibrator vibrators masturbated masturbating masturbate masturbates orgy
        orgies cumshot cum creampie gangbang handjob deepthroat milf sexcam sexcams camgirls fucked cunnilingus fellatio threesome anal
        pussy cocksucker titties hentai dickpics bukkake squirting fick ficken gefickt wichsen muschi titten baiser baisee bite chatte
        branler sodomie follar follando polla coño corrida mamada pajas sexvideos
        camgirl striptease nsfw bdsm creampies threesomes wank wanking boner hardon""",
    SEX_MID: """xxx hardcore topless busty horny nude nudes naked cams cam escorts escort nudity undressed moaned moaning moans lick orgasm erotic strip
        stripping dick cock tits boobs breasts nipples thighs erection thrust thrusting lust uncensored stripped kinky fetish adults sucked licking
        nackte nackt nackten geile geil geiler stohnte stohnend ausziehen ausgezogen erotik
        nues nue nus nu gemissait gemissaient cul sexe coquine coquines erotique
        desnuda desnudas desnudos desnudo gemia gemian calientes sexo erotico tetas culo
        panties thong stripper hooker hookers aroused arousal orgasms erotica bondage seduced foreplay nipple""",
    SEX_WEAK: """sex sexy hot wet breast bare clothes rode ride tonight willing private girls webcams webcam singles fantasy videos clips
        beine heisse live schenkel girls ziehen cuisses chaudes filles adultes webcams seins chicas camaras adultos ropa encima pictures
        pics feel floor bed climbed pressed click wives amateur warten""",
    CLINICAL: """history lecture painting paintings painted museum clinic clinics health screening education determined trout diameter height trees
        engine film novel play medical doctor doctors surgery cancer biology anatomy vaccine study eye beach art sculpture statue portrait
        released release valve species chromosome cells mammogram gemalde ausstellung klinik gesundheit krebs peinture sante clinique musee
        pintura salud clinica museo""",
    SPEECH: """wrote said says called call calls calling report reports reported condemns condemned moderators removed quote quoted quotes
        word words term terms article court accused alleged warns warned describes insult insults slur slurs abuse hate
        schrieb sagte nannte bericht verurteilt wort ecrit disait appelle rapport condamne mot escribio dijo llamo informe condena palabra""",
    BENIGN_NEXT: "son sons proof",
    THE: "the those these",
    DET: "a an the some any more fewer less many much several few my his her our their another one two three ein eine einen einem der die das den un une le la les des du una el los las mi mon ma",
    MODAL: "can could may might should would will shall must do does did have has had let kannst konnt solltest kannt peux pouvez devez puedes puede podeis",
    LINK: "and or so such very really just only nothing but absolute total complete utter real such like as little as alle alles nur echt so wirklich vraiment que qu'un qu'une tan solo vaya",
    OURS: "our us unser unsere unseren unserem unserer uns notre nos nuestro nuestra nuestros nuestras nosotros",
    DESPISE: "hate hates despise despises loathe loathes detest detests hasse hassen hasst verachte deteste detestons meprise odio odiamos desprecio",
    # what stands between a verb and a person who is not its object, and other small words that end a noun
    PREP: "with for to by from at near about mit fur zu von bei avec pour chez con para por",
    FUNC: "of in on who whom whose which that when if because then than there here now again after before under over into out up off too also always ever even von aus auf und oder der qui dans sur dont y en o donde und et ou mais but yet please right",
    LIKE: "like wie comme como",
    WHAT: "what welch was quel quelle que vaya",
}
#: Phrases that count as one word; longest first.
_PHRASES = {
    tuple(w.split("-")): mask
    for mask, text in ((HOSTILE, _WORDS[HOSTILE]), (SELF, _WORDS[SELF]), (THING, _WORDS[THING]), (EXCLUDE, _WORDS[EXCLUDE]), (MUST, _WORDS[MUST]), (SEX_STRONG, "dick-pics nude-pics"), (NOBODY, "no-one"))
    for w in text.split()
    if "-" in w and w != "sous-hommes"
}
_TYPO_CLASSES = INSULT | THING | SLUR_ADJ | GROUP | DEGRADE | EXCLUDE | SEX_STRONG | SEX_MID | VIOLENCE | HOSTILE | DIE

#: Letters that look alike, and marks that stand for letters.
_ALIKE = dict(zip("аеорсухкмтвніјѕɡαορεικνт", "aeopcyxkmtbhijsgaopeiknt"))
_ALIKE |= {"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ł": "l", "đ": "d", "ı": "i"}
_ALIKE = {ord(k): v for k, v in _ALIKE.items()}
_LEET = str.maketrans("013457@$!+€", "oieastasite")
_LEET_L = str.maketrans("013457@$!+€", "oleastaslte")
_EDGE = " \t.,;:!?…\"'()[]{}<>“”„«»‘’‚‹›-–—_~|/\\=#%&`´•·"
_DOTTED = re.compile(r"(?:[^\W\d_][.\-_·*]){2,}[^\W\d_]")
_RUN = re.compile(r"(.)\1+")


def fold(word: str) -> str:
    """Lower-case ASCII letters of a word, accents and look-alike letters resolved; marks are kept."""
    if word.isascii():
        return word
    word = unicodedata.normalize("NFKD", word.translate(_ALIKE))
    return "".join(c for c in word if not unicodedata.combining(c))


def _lexicon() -> dict[str, int]:
    out: dict[str, int] = {}
    for mask, text in _WORDS.items():
        for w in text.split():
            if "-" in w and w not in ("sous-hommes",):
                continue
            w = fold(w).replace("-", "")
            out[w] = out.get(w, 0) | mask
    return out


LEXICON = _lexicon()
LEXICON["*"] = SEX_MID | INSULT
PHRASES = _PHRASES
#: Words of phrases that are too common to be listed as words of their own.
_COMMON = set("no one will would to get my them up va te ta of que hay the you off out let near our live in its his her your do la a dich go auf".split())
for _phrase in PHRASES:
    for _w in set(_phrase) - _COMMON:
        LEXICON[_w] = LEXICON.get(_w, 0) | HINT
PHRASE_FIRST = {p[0] for p in PHRASES}


def phrase_at(words: list[str], i: int) -> int:
    """Classes of the longest phrase that starts at word i; 0 if none does."""
    for n in (4, 3, 2):
        mask = PHRASES.get(tuple(words[i : i + n])) if i + n <= len(words) else None
        if mask:
            return mask
    return 0


_BY_LENGTH: dict[int, list[str]] = {}
_DELETES: dict[str, list[str]] = {}
for _w, _m in LEXICON.items():
    if _w.isalpha() and _m & _TYPO_CLASSES:
        _BY_LENGTH.setdefault(len(_w), []).append(_w)
        if len(_w) >= 5:
            for _i in range(len(_w)):
                _DELETES.setdefault(_w[:_i] + _w[_i + 1 :], []).append(_w)


def _one_typo(word: str) -> str | None:
    """The listed word that differs by one swap, doubled, missing or (in words of 7 letters and more) other letter."""
    n = len(word)
    if n < 5 or not word.isalpha():
        return None
    for w in _DELETES.get(word, ()):
        if len(w) >= 6 and w[0] == word[0]:
            return w
    for i in range(n):
        cut = word[:i] + word[i + 1 :]
        if i and len(cut) >= 6 and LEXICON.get(cut, 0) & _TYPO_CLASSES:
            return cut
        for w in _DELETES.get(cut, ()):
            if len(w) == n and w[0] == word[0]:
                diff = [k for k in range(n) if w[k] != word[k]]
                swap = len(diff) == 2 and diff[1] == diff[0] + 1 and w[diff[0]] == word[diff[1]] and w[diff[1]] == word[diff[0]]
                if swap or (len(diff) == 1 and n >= 7):
                    return w
    return None


#: What a word with most letters starred out counts as: it needs the company of others.
_VAGUE = "*"


def _spelt(word: str) -> str | None:
    """The listed word a written form stands for, or None."""
    if word in LEXICON:
        return word
    if word.endswith("'s") and word[:-2] in LEXICON:
        return word[:-2]
    bare = word.replace("'", "").replace("’", "")
    if bare in LEXICON:
        return bare
    if "'" in word or "’" in word:  # d'abruti, qu'on
        tail = re.split("['’]", word)[-1]
        if tail in LEXICON:
            return tail
    if _DOTTED.fullmatch(word):
        joined = re.sub(r"[.\-_·*]", "", word)
        if joined in LEXICON:
            return joined
    if any(c in "013457@$!+€" for c in word) and any(c.isalpha() for c in word):
        for table in (_LEET, _LEET_L):
            plain = word.translate(table)
            if plain != word and len(plain) >= 3 and (hit := _spelt(plain)):
                return hit
    if "*" in word or "�" in word:
        shape = word.replace("�", "*")
        known = [c for c in shape if c != "*"]
        if len(known) >= 2 and shape[0] != "*":
            pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in shape))
            hits = [w for w in _BY_LENGTH.get(len(shape), ()) if pattern.fullmatch(w)]
            if hits:
                alike = len({LEXICON[w] & _TYPO_CLASSES for w in hits}) == 1 and len(shape) >= 7
                return hits[0] if alike or len(known) * 2 >= len(shape) else _VAGUE
        return None
    if _RUN.search(word):
        for plain in (re.sub(r"(.)\1{2,}", r"\1\1", word), re.sub(r"(.)\1{2,}", r"\1", word), _RUN.sub(r"\1", word)):
            if plain != word and LEXICON.get(plain, 0) & _TYPO_CLASSES:
                return plain
        if re.search(r"(.)\1{2,}", word):  # letters drawn out in several places
            plain = _RUN.sub(r"\1", word)
            for w in _BY_LENGTH.get(len(plain), []) + _BY_LENGTH.get(len(plain) + 1, []) + _BY_LENGTH.get(len(plain) + 2, []):
                if _RUN.sub(r"\1", w) == plain:
                    return w
    return _one_typo(word)


class Tagger(dict):
    """Token as written (lower case) -> (word, classes). Filled as tokens come; bounded by being emptied when large."""

    LIMIT = 400_000

    def __missing__(self, token: str) -> tuple[str, int]:
        if len(self) >= self.LIMIT:
            self.clear()
        word, mask = self._read(token)
        value = self[token] = word, mask | PHRASE if word in PHRASE_FIRST else mask
        return value

    @staticmethod
    def _read(token: str) -> tuple[str, int]:
        mask = 0
        core = token.strip(_EDGE)
        lead, tail = token[: len(token) - len(token.lstrip(_EDGE))], token[len(token.rstrip(_EDGE)) :]
        if any(c in tail for c in ".!?…") and not (len(core) == 1 and core.isalpha()):
            mask |= END
        elif not core and any(c in token for c in ".!?…"):
            mask |= END
        if len(core) == 1 and core.isalpha() and "." in tail:
            mask |= INITIAL
        if any(c in tail for c in ",;"):
            mask |= COMMA
        if any(c in lead for c in "“„«‹‘"):
            mask |= OPEN_QUOTE
        if any(c in tail for c in "”»›"):
            mask |= CLOSE_QUOTE
        if '"' in lead:
            mask |= OPEN_QUOTE
        if '"' in tail:
            mask |= CLOSE_QUOTE
        if not core and not token.strip("!"):
            return token, mask
        word = fold(core)
        if mask & INITIAL:
            return word, mask
        if "-" in word and not _DOTTED.fullmatch(word):  # compounds mean something else: idiot-proof
            joined = word.replace("-", "")
            return word, mask | LEXICON.get(joined, 0)
        hit = _spelt(word)
        if hit is None and core != token:  # marks at the edges may stand for letters: !diot, a$$
            rest = fold(token.strip(_EDGE.replace("!", "")))
            if rest != word and any(c.isalpha() for c in rest):
                hit = _spelt(rest.rstrip("!"))
        if "*" in word.strip("*"):  # starred out: as a listed word, or beyond reading
            mask |= UNREAD if not hit else SURE | STARRED if word.count("*") <= 0.4 * len(word) else STARRED
        if hit is None:
            return word, mask
        if LEXICON[hit] & PRONOUN and word != hit and word.replace("’", "'").endswith("'s"):
            mask |= BE
        return hit, mask | LEXICON[hit]


def parted(word: str) -> str:
    """A word that was spelt with spaces between all letters: as it is if listed, else as the two listed words in it."""
    folded = fold(word)
    if folded not in LEXICON:
        for i in range(3, len(folded) - 2):
            if folded[:i] in LEXICON and folded[i:] in LEXICON:
                return f"{folded[:i]} {folded[i:]}"
    return word
