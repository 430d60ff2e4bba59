"""Word lists and patterns of the feature groups."""

# The results are defined by these lists.

COMMON = """the be to of and a in that have i it for not on with he as you do at this but his by from they we say her
she or an will my one all would there their what so up out if about who get which go me when make can like time no
just him know take people into year your good some could them see other than then now look only come its over think
also back after use two how our work first well way even new want because any these give day most us is are was were
been being has had having does did doing done should could would might must shall very much more many such same
still however therefore""".split()

ADDITIVE = "and also additionally furthermore moreover besides plus likewise similarly indeed".split()
CONTRASTIVE = "but however although though yet nevertheless nonetheless whereas while conversely instead rather still".split()
CONTRASTIVE_PHRASES = ["on the other hand"]
CAUSAL = "because since therefore thus hence consequently so accordingly".split()
CAUSAL_PHRASES = ["as a result", "due to"]

HEDGES = ["maybe", "perhaps", "possibly", "probably", "might", "could", "may", "seems", "appears", "suggests", "likely", "unlikely", "somewhat", "fairly", "rather", "sort of", "kind of", "i think", "i believe", "i guess", "i suppose", "in my opinion", "it seems", "it appears"]
BOOSTERS = ["definitely", "certainly", "clearly", "obviously", "absolutely", "undoubtedly", "surely", "indeed", "in fact", "actually", "of course", "without doubt", "no doubt", "always", "never", "must", "will", "proven", "established", "known"]
PERSONAL = ["i think", "i believe", "i feel", "in my view", "in my opinion", "from my perspective", "personally", "to me", "for me", "my view", "my opinion", "my experience"]
EVIDENTIAL = ["apparently", "reportedly", "allegedly", "supposedly", "according to", "research shows", "studies suggest", "evidence indicates", "data shows"]

TRANSITION_STARTERS = """however therefore furthermore moreover additionally consequently nevertheless nonetheless
meanwhile subsequently accordingly thus hence indeed alternatively conversely similarly specifically notably
importantly interestingly surprisingly unfortunately fortunately obviously clearly first second third finally lastly
next""".split()
AI_STARTERS = ["it is", "this is", "there are", "there is", "in order to", "it should be noted", "it is important", "it is worth noting", "one can", "one should", "we can see", "as mentioned", "as discussed", "as noted", "in conclusion", "to summarize", "overall", "in summary"]
HUMAN_STARTERS = "i you we my but so and well look see okay sure yeah honestly actually basically literally seriously".split()

FUNCTION_WORDS = """the a an and or but in on at to for of with by from as is was are were been be have has had do does
did will would could should may might must can i you he she it we they me him her us them my your his its our their
this that these those who whom which what where when why how if then so than just only also very too not no yes all
any both each few more most other some such into through during before after above below between under again further
once""".split()

PUNCTUATION = ".,;:!?-()[]{}\"'/—–"

TELLS_STRONG = """delve delving delved tapestry multifaceted holistic nuanced nuances comprehensive comprehensively
crucial crucially pivotal pivotally intricate intricacies landscape landscapes realm realms foster fostering fosters
leverage leveraging leverages utilize utilizing utilizes utilized facilitate facilitating facilitates enhance enhancing
enhances robust robustly streamline streamlining optimize optimizing optimizes underscore underscores underscoring
noteworthy commendable meticulous meticulously invaluable indispensable paramount encompasses encompassing elevate
elevating elevates aligns aligning synergy synergies bolster bolstering""".split()
TELLS_MEDIUM = """furthermore moreover additionally subsequently consequently nevertheless nonetheless significantly
essentially fundamentally inherently ultimately arguably notably particularly specifically accordingly thereby thus
hence whereas whereby wherein""".split()

HEDGE_PATTERNS = [
    r"\b(might|may|could|perhaps|possibly|potentially)\b",
    r"\b(generally|typically|usually|often|sometimes)\b",
    r"\b(tends? to|seems? to|appears? to)\b",
    r"\b(in (some|many|most) cases)\b",
    r"\b(it'?s (worth|important) (to )?(note|mention|consider|remember))\b",
    r"\b(keep in mind)\b",
    r"\b(that (being )?said)\b",
    r"\b(to some (extent|degree))\b",
    r"\b(in a sense)\b",
    r"\b(more or less)\b",
]
BENEVOLENT_PATTERNS = [
    r"\b(i'?d be happy to|happy to help)\b",
    r"\b(let me (help|explain|clarify|show|know))\b",
    r"\b(here'?s (how|what|a|the))\b",
    r"\b(i can (help|assist|explain|provide))\b",
    r"\b(feel free to (ask|reach out|let me know|contact))\b",
    r"\b(hope (this|that) helps?)\b",
    r"\b(if you (have|need) (any )?(more |further )?(questions|help|assistance|clarification))\b",
    r"\b(don'?t hesitate to)\b",
    r"\b(glad to (help|assist))\b",
    r"\b(i understand (your|the|that))\b",
    r"\b(that'?s a (great|good|fair|valid|interesting) (question|point))\b",
    r"\b(thank you for (sharing|asking|your))\b",
]
SYCOPHANCY_PATTERNS = [
    r"\b(great|excellent|good|wonderful|fantastic|brilliant) (question|point|observation|insight)\b",
    r"\b(you'?re (absolutely|completely|totally|entirely) right)\b",
    r"\b(that'?s (a |an )?(great|excellent|good|valid|fair|excellent|insightful|thoughtful) (point|question|observation|perspective))\b",
    r"\b(i (completely |totally |absolutely |entirely )?(agree|understand|see your point))\b",
    r"\b(you make (a |an )?(great|excellent|good|valid|compelling|important) point)\b",
    r"\b(that'?s (very |really |quite )?(insightful|thoughtful|interesting|perceptive|astute))\b",
    r"\b(absolutely|definitely|certainly|exactly)[,!]?\s",
    r"\b(you raise (a |an )?(important|valid|good|excellent|great) (point|concern|issue))\b",
    r"\b(i couldn'?t agree more)\b",
    r"\b(well said)\b",
    r"\b(spot on)\b",
]
MORALIZING_PATTERNS = [
    r"\b(it'?s (important|crucial|essential|vital|critical) (to|that))\b",
    r"\b(we (should|must|need to) (always |)?(remember|consider|keep in mind|be mindful))\b",
    r"\b(ethic(s|al|ally)|moral(ly)?)\b",
    r"\b(responsib(ility|le|ly))\b",
    r"\b(ultimately[,]? (what matters|the key|it comes down to|the most important))\b",
    r"\b(at the end of the day)\b",
    r"\b(in conclusion|to conclude|to sum(marize| up)|in summary)\b",
    r"\b(the (key|important|main|critical) (thing|point|takeaway) (is|here))\b",
    r"\b(above all)\b",
    r"\b(first and foremost)\b",
    r"\b(bear in mind)\b",
    r"\b(it bears (mentioning|noting|emphasizing))\b",
]
NEUTRALITY_PATTERNS = [
    r"\b(on (the )?one hand.*on (the )?other( hand)?)\b",
    r"\b(there are (valid )?(arguments|points) (on both|for (and against|both)))\b",
    r"\b(it (depends|varies))\b",
    r"\b(pros and cons)\b",
    r"\b(advantages and disadvantages)\b",
    r"\b(both (sides|perspectives|views|arguments))\b",
    r"\b(some (people |)?(argue|believe|think|say).*while others)\b",
    r"\b(from (one|a certain|another) perspective)\b",
    r"\b(there'?s no (one[- ]size[- ]fits[- ]all|simple|easy) answer)\b",
    r"\b(it'?s (complex|complicated|nuanced|multifaceted))\b",
    r"\b(balancing|balance between)\b",
    r"\b(trade-?offs?)\b",
    r"\b(on balance)\b",
]
PREMISE_PATTERNS = [
    r"\b(because|since|given that|as|considering)\b",
    r"\b(first(ly)?|second(ly)?|third(ly)?|finally)\b",
    r"\b(the (reason|fact) (is|that))\b",
    r"\b(for (one|another) thing)\b",
    r"\b(to begin with)\b",
]
CONCLUSION_PATTERNS = [
    r"\b(therefore|thus|hence|consequently|accordingly)\b",
    r"\b(so[,]? (we can|it follows|this means|this suggests))\b",
    r"\b(this (shows|demonstrates|proves|indicates|suggests|implies))\b",
    r"\b(in conclusion|to conclude)\b",
    r"\b(as a result)\b",
    r"\b(it follows that)\b",
]
HUMAN_PATTERNS = [
    r"\b(gonna|wanna|gotta|kinda|sorta|dunno|lemme|gimme)\b",
    r"\b(lol|lmao|rofl|haha|hahaha|heh|wtf|omg|omfg|idk|imo|imho|tbh|ngl|smh|fwiw)\b",
    r"\b(yeah|yep|nope|yup|nah|uh|um|uhh|umm|hmm|mhm)\b",
    r"\.{3,}",
    r"!{2,}",
    r"\?{2,}",
    r"[!?]{2,}",
    r"\bu\b",
    r"\bur\b",
    r"\br\b",
    r"\bw/\b",
    r"\bb/c\b",
    r"\bpls\b",
    r"\bthx\b",
    r"\b(ok|okay|alright|anyways|anyhoo)\b",
    r"\b(stuff|thingy|whatnot|whatchamacallit)\b",
    r"\b(kinda|sorta|prolly|probs)\b",
    r"\b(like,|so,|well,|anyway,|basically,)\b",
    r"\b\w+in'\b",
]
TYPO_PATTERNS = [
    r"\b(teh|hte|taht|waht|adn|nad|jsut|wiht|thier|becuase|recieve|seperate)\b",
    r"\b\w*([a-z])\1{3,}\w*\b",
    r" {2,}",
    r",,+",
]
ALIGNMENT_WEIGHTS = {
    "formal": {"moralizing_coda": 0.10, "lexical_tellscore": 0.50, "uniformity_score": 0.40},
    "conversational": {"benevolence_score": 0.15, "neutrality_bias": 0.05, "moralizing_coda": 0.08, "syllogism_stability": 0.02, "sycophancy_index": 0.15, "lexical_tellscore": 0.25, "uniformity_score": 0.15, "imperfection_absence": 0.15},
    "general": {"benevolence_score": 0.08, "neutrality_bias": 0.05, "moralizing_coda": 0.12, "syllogism_stability": 0.02, "sycophancy_index": 0.03, "lexical_tellscore": 0.35, "uniformity_score": 0.30, "imperfection_absence": 0.05},
}
ALIGNMENT_NORMS = {"benevolence_score": 0.5, "neutrality_bias": 0.5, "moralizing_coda": 0.5, "syllogism_stability": 0.1, "sycophancy_index": 0.2, "lexical_tellscore": 3.0, "uniformity_score": 1.0, "imperfection_absence": 1.0}
ALIGNMENT_THRESHOLDS = {"formal": 0.11, "conversational": 0.20, "general": 0.15}

GLITCHES = ["SolidGoldMagworthy", "rawdownload", "rawdownloadclone", "reportprint", "embedreportprint", "cloneembedreportprint", "TheNitrome", "TheNitromeFan", "GradlentGrailpoints", "PsjMQKWGnE", "Smartstocks", "ForgeModLoader", "RandomRedditorWithNo", "exaborations", "attRot"]
