"""Word lists that decide results. All lists here are fixed values."""

from __future__ import annotations

ENGLISH = (
    "a", "about", "all", "also", "am", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "could", "do", "does", "for", "from", "had",
    "has", "have", "he", "her", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "more", "my", "not", "of", "on", "or", "our",
    "she", "should", "so", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "too", "us", "was", "we", "were",
    "what", "when", "which", "who", "will", "with", "would", "you", "your",
)

SPANISH = (
    "algo", "algun", "alguna", "algunas", "alguno", "algunos", "ante", "antes", "aquel", "aquella", "aquellas", "aquello", "aquellos", "aqui",
    "aquí", "cada", "como", "con", "contra", "cual", "cuales", "cuando", "del", "desde", "donde", "dos", "durante", "ella", "ellas", "ello", "ellos",
    "entre", "era", "eran", "eras", "eres", "esa", "esas", "ese", "eso", "esos", "esta", "está", "estaba", "estado", "estan", "están", "estar",
    "este", "esto", "estos", "fue", "fueron", "hasta", "hay", "las", "les", "los", "mas", "más", "mis", "mucho", "muy", "nos", "nosotros", "otra",
    "otras", "otro", "otros", "para", "pero", "por", "porque", "que", "qué", "sea", "sin", "sobre", "son", "sus", "tambien", "también", "tan",
    "tiene", "tienen", "todo", "todos", "una", "unas", "uno", "unos", "usted", "ustedes",
)

#: Words about the survey itself rather than its subject.
DOMAIN = (
    "better", "looking", "need", "resource", "resources", "using",
)

STOPWORDS = tuple(dict.fromkeys((*ENGLISH, *DOMAIN, *SPANISH)))

RELEVANCE_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "i", "in", "is", "it", "of", "on", "or", "our", "resource", "resources",
    "so", "that", "the", "their", "this", "to", "too", "we", "with",
)

LEADING_TRIM = (
    "a", "an", "and", "are", "as", "be", "been", "being", "but", "for", "from", "i", "in", "is", "it", "of", "on", "or", "our", "that", "the",
    "their", "these", "this", "those", "to", "was", "we", "were", "with", "you", "your",
)

TRAILING_TRIM = (
    "a", "an", "and", "are", "as", "be", "been", "being", "but", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "these", "this",
    "those", "to", "was", "were", "with",
)
