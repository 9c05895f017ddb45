"""Small invented files for the operators that read markup, coreference and names."""

from __future__ import annotations

MARKUP = """<ROOT><DOC><DOCNO> D1 </DOCNO>
<ENAMEX TYPE="ORGANIZATION:CORPORATION">Acme Co .</ENAMEX> sued <ENAMEX TYPE="ORGANIZATION:CORPORATION">Bolt Inc.</ENAMEX> .
It said <ENAMEX TYPE="ORGANIZATION:CORPORATION">Bolt</ENAMEX>'s chief <ENAMEX TYPE="PERSON">Al Ray</ENAMEX> left .
</DOC><DOC><DOCNO> D2 </DOCNO>
<ENAMEX TYPE="ORGANIZATION:CORPORATION">Acme</ENAMEX> and <ENAMEX TYPE="ORGANIZATION:CORPORATION">Bolt Inc.</ENAMEX> met <ENAMEX TYPE="ORGANIZATION:CORPORATION">Cogs PLC</ENAMEX> .
</DOC></ROOT>
"""

CHAINS = """(
D1
(
Antecedent -> S1:1-3 -> Acme Co .
Pronoun -> S2:1-1 -> It
)
(
Antecedent -> S2:1-1 -> It
Pronoun -> S2:7-7 -> left
)
(
Antecedent -> S1:1-3 -> not the text
Pronoun -> S2:2-2 -> said
)
)
(
D2
)
"""

BROKEN = {
    "fragments": "<DOC>a</DOC><DOC>b</DOC>\n",
    "and": "<ROOT><DOC>AT&T and R & D &amp; x</DOC></ROOT>\n",
    "mismatch": '<ROOT><DOC><ENAMEX TYPE="X">a</NUMEX></DOC></ROOT>\n',
    "cut": "<ROOT><DOC>a</DOC></ROOT\n",
    "several": "<DOC>AT&T</DOC><DOC>b</DIC>\n",
    "clean": "<ROOT><DOC>a</DOC></ROOT>\n",
    "hopeless": "<ROOT><DOC a=></DOC></ROOT>\n",
}

NAMES = ["Acme Co.", "Acme", "The Atlantic and Pacific Company", "A&P Company", "Time-Warner", "Time Warner Inc.", "Goldman, Sachs & Co.", "Goldman Sachs", "International Business Machines Corp.", "IBM", "Lloyd 's", "Lloyd 's Bank", "The The Band", "Guber/Peters", "R & D , Inc.", "Dunkin'", "PLC"]
"""Names for suffix, prefix, punctuation and alias cases."""

PAIRS = [("IBM", "International Business Machines"), ("Amex", "American Express"), ("Conrail", "Consolidated Rail"), ("TWA", "Time Warner"), ("MCI", "McDermott International"), ("A&P", "Atlantic and Pacific"), ("Alcoa", "Aluminum Company of America"), ("Acme", "Bolt"), ("TRW", "The Ringing World")]
