"""A small dictionary of our own for queries, tests and benchmarks over the driver's tables."""

from __future__ import annotations

_WORDS = "the th and an en er ing tion de la le que der die un una los las des nd re ti ou ed on st ha in of to is it a e i ción lich sch auf idiot scum the the er ing que"
LEXICON = "\n".join(f"{w},{i % 9 + 1},{(i * 7) % 9 + 1},{400 + 130 * ((i * 5) % 11) - 180 * len(w)},{'NOUN' if i % 3 else 'VERB'},{w.upper()},\"x,{i % 4}\"" for i, w in enumerate(_WORDS.split())) + "\n\" \",9,9,50,SPACE,_\n\",\",8,8,-20,COMMA,_\n"
USER = "tion the,3,4,-900,USER,COMPOUND\nthe,2,2,100,USER,THE\nand,1,1,-300,USER,AND\n"
CHAR = """# name invoke group length
DEFAULT 0 1 0
SPACE 0 1 0
ALPHA 1 1 3
UPPER 1 0 2
ACCENT 0 0 2
DIGIT 1 1 0
PUNCT 1 1 1
0x0020 SPACE
0x0009..0x000D SPACE
0x0061..0x007A ALPHA
0x0041..0x005A UPPER ALPHA # capital letters run on into words
0x0030..0x0039 DIGIT
0x0021..0x002F PUNCT
0x003A..0x0040 PUNCT
0x00C0..0x00DE UPPER ACCENT
0x00DF..0x00FF ACCENT ALPHA
"""
UNKNOWN = """DEFAULT,1,1,2500,UNK,*
SPACE,9,9,300,BLANK,*
ALPHA,2,3,1900,UNK,ALPHA
ALPHA,4,5,2100,NAME,ALPHA
UPPER,5,2,2000,NAME,UPPER
ACCENT,6,6,1800,UNK,ACCENT
DIGIT,7,7,900,NUM,*
PUNCT,8,8,500,SIGN,*
"""
SIZE = 10
MATRIX = f"{SIZE} {SIZE}\n" + "\n".join(f"{r} {l} {((r * 37 + l * 91) % 23) * 40 - 400}" for r in range(SIZE) for l in range(SIZE) if (r + 2 * l) % 5) + "\n3 4 -77\n"
TEMPLATES = 10
BIGRAM_RIGHT = "\n".join(f"{i}\t" + ",".join(f"R{k}{(i * (k + 2)) % (k + 3)}" for k in range(TEMPLATES)) for i in range(1, SIZE))
BIGRAM_LEFT = "\n".join(f"{i}\t" + ",".join(f"L{k}{(i * (k + 1)) % (k + 2)}" for k in range(TEMPLATES)) for i in range(1, SIZE))
BIGRAM_COST = "\n".join(f"R{k}{a}/L{k}{b}\t{(a * 13 + b * 29 + k * 7) % 61 - 30}" for k in range(TEMPLATES) for a in range(k + 3) for b in range(k + 2) if (a + b + k) % 3) + "\n/L00\t15\nR01/\t-9\n"
