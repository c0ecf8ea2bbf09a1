"""Sentences written before the word lists were last changed and never used for them: what the grammar does with these
is its figure for sentences nobody fitted it to. Do not take words or patterns from here."""

AFFECTED = [
    "You are such a pathetic little worm, nobody respects you.",
    "What an absolute imbecile you turned out to be.",
    "You lying piece of garbage, I hope you rot.",
    "Shut your mouth, you ignorant cow.",
    "He is a dishonest weasel and a coward.",
    "Your brother is a complete moron.",
    "If you come back here I will smash your face in.",
    "We are going to hunt you down and hurt you.",
    "I swear I'll strangle you with my own hands.",
    "Someone should put a bullet in your head.",
    "Go jump off a bridge, loser.",
    "Drop dead, you useless waste of space.",
    "You disgust me, you filthy animal.",
    "Those migrants are nothing but criminals and leeches.",
    "Send all the Muslims back where they came from.",
    "Gays are sick and should not be allowed near children.",
    "Women are too emotional and dumb to lead anything.",
    "Black people are inferior and lazy.",
    "Jews control everything and must be wiped out.",
    "We should burn down every one of their mosques.",
    "No decent person wants gypsies living in this street.",
    "Disabled people are a burden and should be put down.",
    "She sucked his cock until he came.",
    "Watch horny teens get fucked hard on camera.",
    "Free uncensored porn, click here now.",
    "He slid his fingers between her wet thighs.",
    "I want to feel your naked body on top of mine.",
    "Du bist so ein dummes Schwein.",
    "Ihr seid alle verdammte Versager.",
    "T'es vraiment qu'une grosse merde.",
    "Eres un cerdo asqueroso y un cobarde.",
    "Los inmigrantes son una plaga y hay que echarlos.",
    "Die Ausländer sollen endlich verschwinden.",
    "I'm going to make you bleed.",
    "Kill yourself, you worthless freak.",
]
HARMLESS = [
    "You should feed the pigs before noon.",
    "I will send you a copy of the report on Friday.",
    "We will beat you to the top of the hill, said the guide with a laugh.",
    "Your dog is a lovely animal.",
    "The garbage is collected on Tuesdays, so please put yours out early.",
    "You can cut the bread while I heat the soup.",
    "I could hang your coat by the door.",
    "They will shoot the film in your neighbourhood next week.",
    "My grandmother kept rats as pets when she was young.",
    "Immigrants opened most of the bakeries in this street.",
    "The refugees are engineers, teachers and nurses.",
    "Women are paid less than men in many trades.",
    "Muslims are celebrating the end of the fast today.",
    "The Jews of the town were deported in 1942 and most were murdered.",
    "He was beaten in the final by two points.",
    "The nude in the second room was painted in 1881.",
    "Breast cancer screening is free for women over fifty.",
    "The author describes how soldiers called the villagers vermin.",
    "Nobody called you an idiot.",
    "It would be stupid to sail in this weather.",
    "You are not a failure, whatever they told you.",
    "The word bastard comes from Old French.",
    "The children burned the rubbish in your yard by mistake.",
    "Kill the weeds before they spread to your roses.",
    "I was so tired that I could have died, you know.",
    "The coward in the play turns out to be a hero.",
    "You look stunning in that dirty old coat.",
    "Break a leg tonight, we are all thinking of you.",
    "Du kannst die Schweine füttern.",
    "Die Flüchtlinge sind gestern angekommen.",
    "Vous pouvez tuer les mauvaises herbes au printemps.",
    "La basura se recoge los lunes, no la saques antes.",
    "Sex education is taught in the eighth year.",
    "The strip of land between the rivers is wet in winter.",
    "The doctor will cut the stitches and examine your wound.",
]
