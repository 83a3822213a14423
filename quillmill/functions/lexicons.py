"""Word lists, phrases and thresholds that results depend on."""

# fixed values: function words of the diagnostics
STOPWORDS = """
the a an and or but to of in on at for with as is are was were be been it that this by from i you he she they we me my
our your their his her its so if then than very just into out over under up down off about before after again already
first back not did does do done can could would should will shall have has had because while through against inside
outside like what said them each one other sometimes didnt dont cant wont youre thats theres
""".split()

# fixed values: words that make no theme
THEME_BLOCKLIST = "about before after already first just because through inside against forward back really maybe still around like what".split()

# fixed values: what contractions leave behind
CONTRACTION_PARTS = "s t re ve ll d m".split()

# fixed values: function words of the type-token density
DENSITY_STOPWORDS = "a an and are as at be but by for from has he in is it its of on or that the their there to was were will with you your".split()

# fixed values: low-signal phrases and hedges
LOW_SIGNAL_PHRASES = ["in the end", "at the end of the day", "quietly", "silence", "together", "hope"]
HEDGES = ["maybe", "perhaps", "somewhat", "kind of", "sort of", "almost"]

# fixed values: the ending lexicon and its patterns
ABSTRACT_NOUNS = "journey testament horizon legacy tapestry beacon complexity understanding resilience possibility reflection purpose".split()
VAGUE_ADJECTIVES = "bittersweet uncertain lingering hopeful transformative newfound quiet gentle subtle intangible".split()
ENDING_PHRASES = [
    "hand in hand", "only time would tell", "a sense of what was to come", "the path ahead was unclear", "the road ahead was unclear", "whatever came next", "what lay ahead",
    "in the end", "along the way", "what mattered most", "couldn't help but feel", "it wasn't about", "they found along the way",
]
ENDING_PATTERNS = [r"as they .*?couldn't help but feel that", r"in the end,? it wasn't about .*? but about"]

# fixed values: sentiment and ambivalence
POSITIVE = "hope hopeful promise bright light warm renew renewal future healing growth resolve peace optimism".split()
NEGATIVE = "cold grim dark bleak uncertain loss fear risk fracture ruin regret dread".split()
AMBIVALENT = "seemed almost nearly just like felt".split()

# fixed values: concreteness hints
CONCRETENESS = {"high": 4.2, "medium": 3.0, "low": 1.8}
CONCRETENESS_DEFAULT = 2.5

# fixed values: thresholds of the diagnostics
LEAST_TOKENS, LOW_DENSITY = 8, 0.45
PAIR_SIMILARITY, PAIR_SHARED = 0.58, 5
BURST_Z, BURST_STRENGTH, BURST_DF, WIDE_SHARE = 2.2, 9.0, 4, 0.35
