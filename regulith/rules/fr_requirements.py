"""Markers of requirement types, domains, rejections and errors. The compliance domain's own, in their natural order.

Markers are compared with lower-cased text without accents, so each stands once, in plain letters.
"""

TYPES = ("OBLIGATION", "INTERDICTION", "RESPONSABILITE", "EXCEPTION", "CONDITION", "DECLARATION", "CONTROLE", "REGISTRE", "AUTRE")
TYPE_ALIASES = {"EXEMPTION": "EXCEPTION", "RESPONSIBILITY": "RESPONSABILITE", "RESPONSABILITÉ": "RESPONSABILITE", "CONTROL": "CONTROLE", "REGISTER": "REGISTRE", "OTHER": "AUTRE", "DECLARATIVE": "DECLARATION", "PROHIBITION": "INTERDICTION", "BAN": "INTERDICTION"}

RESPONSIBILITY = ("repond de", "responsable de", "est responsable de", "imputables a sa faute")
EXCEPTION = ("sauf", "cependant", "toutefois", "sous reserve de", "sous reserve que", "par derogation", "ne repond que", "n'en repond que", "n’en repond que")
INTERDICTION = ("interdit", "est interdit", "sont interdits", "ne doit pas", "ne doivent pas", "est rejete", "sont rejetes", "rejete obligatoirement")
CONDITION = ("si ", "lorsque", "en cas de", "a condition de", "a condition que", "sous reserve que")
FIXED = ("est fixe", "est fixee", "sont fixes", "sont fixees")
OBLIGATION = ("doit", "doivent", "est tenu de", "sont tenus de", "tenu de", "tenus de", "oblige de", "prend en charge", "beneficie", "beneficient", *FIXED, "sera tenu a la disposition", "sera tenue a la disposition")
DECLARATION = ("doit notifier", "doit declarer", "doit informer", "doit transmettre", "doit adresser", "doit communiquer", "doivent communiquer", "communiquer chaque annee", "communiquent chaque annee", "transmettre chaque annee", "adresser chaque annee", "informer chaque annee", "fournir chaque annee", "demandes de candidature", "demande de candidature", "doivent etre enregistrees", "doit etre accompagnee", "doit etre accompagne", "est fixee conformement", "est fixe conformement", "sont recouvrees", "sont affectees", "sur la base de titres")
REPORTING_VERB = ("communiqu", "transmett", "adress", "fourn", "inform", "declar", "notifi")
REPORTING_TARGET = ("ministere", "autorite", "autorites", "inspection", "administration", "service competent", "autorites competentes", "organisme", "office", "agence")
REPORTING_PAYLOAD = ("information", "informations", "donnees", "renseignement", "renseignements", "rapport", "declaration")
ELIGIBLE = ("peut participer", "peuvent participer", "peut beneficier", "peuvent beneficier", "est ouvert aux", "sont ouverts aux", "ouvre droit", "ouvrent droit")
ELIGIBLE_BY = ("titulaire", "titulaires", "anciennet", "diplom", "licence", "maitrise", "justifiant", "remplissant les conditions", "sur dossiers")
EFFECT = ("prend en charge", "peut beneficier", "peuvent beneficier", "peut participer", "peuvent participer", "beneficie", "beneficient", "est ouvert aux", "sont ouverts aux", "ouvre droit", "ouvrent droit", *FIXED, "fixe conformement", "fixee conformement", "fixes conformement", "fixees conformement")
EFFECT_OF_CONDITION = ("peut beneficier", "peuvent beneficier", "beneficie", "beneficient", "peut participer", "peuvent participer", "est ouvert aux", "sont ouverts aux", "ouvre droit", "ouvrent droit")
REGISTER = ("tenir un registre", "tenir le registre", "registre doit etre presente", "registre doit etre tenu", "registre est tenu", "est tenu et conserv", "est conserve", "conserve pendant", "presente a toute requisition", "numerote", "paraphe", "consigne", "a la disposition")

# Domains: guards, rules that come first, markers of each sub-domain, and the domain of a type.
DOMAIN_NOISE = ("non immatricule", "superficie de cette parcelle", "ben mohamed", "bent ", "gouvernorat de")
INSTITUTIONS = ("jury", "commission", "conseil", "comite", "organe")
RECRUITING = ("concours", "candidat", "candidature", "redeploiement", "anciennete", "postes a pourvoir")
DOCUMENTS = ("bureau d ordre", "enregistree au bureau d ordre", "enregistrees au bureau d ordre", "enregistree au bureau d'ordre", "enregistrees au bureau d'ordre", "pieces justificatives", "formulaire")
HARD_INTERDICTION = ("fraude", "tentative de fraude", "exclusion immediate", "annulation de l'epreuve", "est rejetee", "rejetee obligatoirement", "interdit")
CONDITION_OF_RIGHT = ("beneficie", "ayant subi", "en cas de", "lorsque", "a condition de")
OBLIGATION_CLAUSE = ("doit", "doivent", "est tenu de", "sont tenus de", "s'engage a", "s'engagent a")
CONDITION_CLAUSE = ("en cas de", "si ", "lorsque", "a condition de", "sous reserve de")
ORGANISING = ("il est cree", "est cree", "composition", "compose de", "composee de", "composees de", "quorum", "membres", "commission", "conseil")
CONTROLLING = ("audit", "inspection", "verification", "supervision", "surveillance")
ANSWERING = ("est charge de", "sont charges de", "est charge", "sont charges", "doit assurer", "doit proposer", "doit classer", "doit proceder", "doit decerner", "repond de", "incombe")
SUB_DOMAINS = (
    ("QHSE", "SECURITE_TRAVAIL", ("securite au travail", "sante et securite", "equipement de protection", "accident du travail", "danger grave", "incendie", "evacuation")),
    ("QHSE", "HYGIENE", ("hygiene", "salubrite", "assainissement", "nettoyage", "sanitaire")),
    ("QHSE", "ENVIRONNEMENT", ("environnement", "dechet", "dechets", "pollution", "effluent", "emission", "rejet")),
    ("QHSE", "RISQUES_PROFESSIONNELS", ("risque professionnel", "risques professionnels", "maladie professionnelle", "exposition au risque", "evaluation des risques", "evaluation du risque")),
    ("QHSE", "PREVENTION", ("prevention", "prevenir", "mesures preventives", "plan de prevention", "dispositif preventif")),
    ("RESSOURCES_HUMAINES", "RECRUTEMENT", ("concours", "candidature", "dossier de candidature", "demandes de candidature", "date de cloture", "inscrire leurs candidatures", "concours interne", "concours sur dossiers", "ouvert au concours", "concours est ouvert", "recrutement", "embauche", "admis", "anciennete dans le grade", "anciennete generale", "postes a pourvoir", "priorite est accordee", "plus age", "redeploiement", "specialites")),
    ("RESSOURCES_HUMAINES", "FORMATION", ("formation", "stage", "apprentissage", "qualification", "renforcement des competences")),
    ("RESSOURCES_HUMAINES", "CONDITIONS_TRAVAIL", ("temps de travail", "horaire de travail", "conditions de travail", "conge", "remuneration", "salaire", "repos hebdomadaire")),
    ("RESSOURCES_HUMAINES", "GESTION_PERSONNEL", ("gestion du personnel", "personnel", "employe", "travailleur", "agent", "evaluation du personnel", "mobilite du personnel")),
    ("GOUVERNANCE", "RESPONSABILITES", ("responsable de", "est charge de", "sont charges de", "repond de", "incombe", "doit assurer", "doit evaluer", "doit proceder", "doit classer", "doit proposer", "doit decerner")),
    ("GOUVERNANCE", "ORGANISATION", ("commission", "jury", "conseil", "composition", "compose de", "composee de", "composees de", "quorum", "membres", "organe")),
    ("GOUVERNANCE", "CONTROLE", ("controle", "audit", "inspection", "verification", "supervision", "surveillance")),
    ("GOUVERNANCE", "CONFORMITE_INTERNE", ("conformite interne", "non-conformite", "dispositif interne", "regle interne", "procedure interne")),
    ("JURIDIQUE_GENERAL", "INTERDICTIONS", ("interdit", "est interdit", "ne doit pas", "ne peuvent pas", "est rejetee", "rejetee obligatoirement", "prohibe", "fraude", "tentative de fraude", "exclusion immediate", "annulation de l'epreuve")),
    ("JURIDIQUE_GENERAL", "CONDITIONS_REGLEMENTAIRES", ("a condition de", "sous reserve de", "lorsque", "en cas de", "condition d eligibility", "conditions d eligibilite")),
    ("JURIDIQUE_GENERAL", "SANCTIONS", ("est puni", "sont punis", "amende", "sanction", "passible", "penalite")),
    ("JURIDIQUE_GENERAL", "OBLIGATIONS_LEGALES", ("doit", "doivent", "est tenu de", "sont tenus de", "obligatoire", "est fixe", "est fixee", "s'engage a", "s'engagent a")),
    ("TECHNIQUE_OPERATIONNEL", "PROCEDURES", ("procedure", "procedures", "modalites", "processus", "protocole", "etapes")),
    ("TECHNIQUE_OPERATIONNEL", "MAINTENANCE", ("maintenance", "entretien", "reparation", "controle technique", "maintenance preventive")),
    ("TECHNIQUE_OPERATIONNEL", "EXPLOITATION", ("exploitation", "operation", "fonctionnement", "mise en service", "mise en exploitation")),
    ("TECHNIQUE_OPERATIONNEL", "INSTALLATIONS", ("installation", "equipement", "infrastructure", "reseau", "dispositif technique")),
    ("ADMINISTRATIF", "DECLARATION", ("declaration", "declare", "doit notifier", "doit informer", "doit transmettre", "signaler")),
    ("ADMINISTRATIF", "AUTORISATION", ("autorisation", "agrement", "homologation", "permis", "visa administratif")),
    ("ADMINISTRATIF", "REGISTRE", ("registre", "registre special", "livre de bord", "journal de", "tenue du registre")),
    ("ADMINISTRATIF", "DOCUMENTATION", ("dossier", "document", "pieces justificatives", "piece justificative", "formulaire", "proces-verbal", "rapport", "certificat", "pv", "bureau d ordre", "enregistree au bureau d ordre", "enregistrees au bureau d ordre", "enregistree au bureau d'ordre", "enregistrees au bureau d'ordre")),
)
TYPE_DOMAIN = {
    "REGISTRE": ("ADMINISTRATIF", "REGISTRE"),
    "DECLARATION": ("ADMINISTRATIF", "DECLARATION"),
    "CONTROLE": ("GOUVERNANCE", "CONTROLE"),
    "RESPONSABILITE": ("GOUVERNANCE", "RESPONSABILITES"),
    "INTERDICTION": ("JURIDIQUE_GENERAL", "INTERDICTIONS"),
    "CONDITION": ("JURIDIQUE_GENERAL", "CONDITIONS_REGLEMENTAIRES"),
    "EXCEPTION": ("JURIDIQUE_GENERAL", "CONDITIONS_REGLEMENTAIRES"),
    "OBLIGATION": ("JURIDIQUE_GENERAL", "OBLIGATIONS_LEGALES"),
    "AUTRE": ("JURIDIQUE_GENERAL", "OBLIGATIONS_LEGALES"),
}

# Predicates of statements. Patterns are for text without accents.
MISSING_CONDITION = ("sauf", "si ", "lorsque", "en cas de", "sous reserve de", "a condition de", "peril en la demeure")
MISSING_SCOPE = ("dans les etablissements", "dans l'etablissement", "dans les locaux", "sur les lieux", "au sein de", "a l'interieur de", "dans les cas ou", "ou s'effectuent", "ou s'effectue", "ou se fait")
SUBJECTS = (("employeur", ("employeur",)), ("salarie", ("salarie", "travailleur")), ("entreprise", ("entreprise",)), ("convention", ("convention collective",)), ("registre", ("registre",)))
BARE_WORDS = ("affichage", "notification", "declaration", "registre", "controle")
LOW_VALUE_VERB = r"\b(doit|doivent|est|sont|interdit|repond|sera|seront|peut|peuvent|tenu|tenus|responsable|presente|beneficie|beneficient|entraine|entrainent|communique|communiquent|ouvre|ouvrent|incombe|incombent|prend\s+en\s+charge|sous\s+reserve\s+de|a\s+condition\s+de|procede|procedent|redevient|redeviennent|fait\s+foi|fixe|fixent|fixee?s?)\b"
GAZETTE = r"\bjournal\s+officiel\s+de\s+la\s+republique\s+tunisienne\b"
NAME_CHAIN = r"\bben\s+\w{2,}\s+(ben|bou|ou[a-z]+)\b"
PUBLICATION = r"\b(l['‘]|le|la)\s+presente?\s+(arrete?(\s+conjoint)?|decret(-loi)?|loi)\s+sera\s+(publiee?|executee?)\b"
INDIVIDUAL_ACTS = ("nomination", "nommer", "est nomme", "sont nommes", "designation", "designer", "est designe", "charge de fonctions", "chargee de fonctions", "fin de fonctions", "cessation de fonctions", "mise a la retraite", "admission a la retraite", "delegation de signature", "affectation", "mutation")
PERSONS = ("monsieur", "madame", "mme", "m.", "dr ", "professeur ")
GENERAL_ACTS = ("conditions d'application", "conditions d’octroi", "conditions d'octroi", "modalites", "concours interne", "modalites d'organisation", "fixant les modalites", "cahier des charges", "statut particulier", "fixation", "bareme", "baremes", "taux", "liste des zones", "liste des beneficiaires", "registre", "declaration", "contribution", "cotisation", "agrement des organismes")
GENERAL_NORMS = ("doit", "doivent", "est tenu de", "sont tenus de", "interdit", "en cas de", "lorsque", "sauf", "communique", "communiquent", "transmet", "transmettent", "adresse", "adressent", "prend en charge", "beneficie", "beneficient")
RISK = ("doit", "doivent", "est tenu de", "tenu de", "est tenue de", "tenus de", "interdit", "est interdit", "sont interdits", "peut", "peuvent", "sauf", "lorsque", "si ", "en cas de", "a condition de", "a condition que", "a moins que", "sous reserve", "sous reserve de", "beneficie", "beneficient", "prend en charge", "communique", "communiquent", "transmet", "transmettent", "adresse", "adressent", "ouvre droit", "incombe", "incombent", "fait foi", "fixe", "fixent", "est rejetee", "sont rejetees", "entraine", "entrainent", "exclusion", "annulation", "est puni", "sont punis", "est passible")
CROSS_REFERENCE = r"\b(article\s+\d+|conformement\s+aux\s+dispositions\s+de|sous\s+reserve\s+de\s+l'?article|en\s+application\s+de\s+l'?article|prevu\s+a\s+l'?article|vise\s+a\s+l'?article)\b"
# Individual acts among requirements (those among a gazette's acts are above).
ACT_NAME = r"\b(monsieur|madame|m\.|mme\.?)\s+[a-z][a-z'\-]{1,}"
ACT_MARKERS = ("est nomme", "sont nommes", "est nommee", "est designe", "sont designes", "charge des fonctions de", "chargee des fonctions de", "par delegation", "est habilite a signer", "delegation de signature", "acceptation de demission", "delegation de signature accordee a monsieur", "delegation de signature accordee a madame")
INSTITUTIONAL_SUBJECTS = ("direction generale", "ministere", "administration", "etablissement", "agriculteurs", "fonds national")
INSTITUTIONAL_CUES = ("jury", "concours", "candidat", "commission", "deliberation", "notation", "classement", "postes a pourvoir", "anciennete dans le grade")

# Filters of requirements.
LONE_LETTER = r"^[àâäéèêëîïôöùûüç]\s"
LOWER_START = r"^[a-zàâäéèêëîïôöùûüç]"
HEADER_START = r"^(art\.?|article|\d+\s*[-:])"
SHORT_STARTS = ("l", "le", "la", "les", "un", "une", "ce", "ces", "cette", "si", "au", "aux", "du", "de", "des", "en", "dans", "il", "elle", "a", "d")
SUBJECT_START = r"^(l|les|le|la|un|une|toute?|ce|ces|cette|il|elle|employeur|travailleur|salarie|entreprise|etablissement|registre|conseil|commission|ministre|declaration)\b"
CUT_START = r"^(tre|etre|fixe?e?s?|indique?e?s?|prevu(e|es)?|prolonge?e?|olonge?e?|charge?e?s?|habilite?e?s?)\b"
LINK_START = r"^(de|du|des|d|et|ou|aux|au|a|pour|avec|sur|sous|dans)\b"
SENTENCE_START = r"^(l|les|le|la|un|une|toute?|ce|ces|cette|si|lorsque|en\s+cas|dans\s+le\s+cas)\b"
STRONG_START = r"^(toute?|les|le|la|l'|une?|ce|ces|il|en\s+cas|dans\s+le\s+cas|au\s+cours|sous\s+reserve|si|lorsque|durant)\b"
STRONG_WORD = r"\b(doit|doivent|est\s+tenu|sont\s+tenus|interdit|obligatoire|peut|peuvent|habilit\w*|charg\w*|communiquer|transmettre|notifier|conserver|present\w+|registre|declar\w+)\b"
BAD_START = r"^(art\.?|article|\d{1,3}\s*[-:]|de|du|des|d'|et|ou|aux|au|a)\b"
SINGULAR_PLURAL = r"^(un|une|le|la|l|ce|cette)\s+(registre|document|contrat|plan|conseil|proces-verbal|proces verbal)(\s+[a-z-]+){0,6}\s+sont\b"
PLURAL_SINGULAR = r"^(les|ces)\s+(documents?|contrats?|plans?|membres?|autorites?)(\s+[a-z-]+){0,6}\s+est\b"
SCOPE_OF_APPLICATION = ("doit etre inclus dans le champ d'application",)
SCOPE_SOURCES = ("dans tout etablissement compris dans le champ d'application", "dans les etablissements soumis a l'application", "en ce qui concerne", "sont etendues aux categories")
SCOPE_NORMS = ("doit", "doivent", "est tenu de", "sont tenus de", "sera tenu a la disposition", "sera tenue a la disposition", "s'imposent")
EXCEPTION_SUBJECT = r"\b(employeur|salarie|candidat|jury|commission|agent|organisme|entreprise|etablissement|directeur|ministre|titulaire)\b"
EXCEPTION_VERB = r"\b(peut|doit|doivent|est tenu|sont tenus|interdit|obligatoire|justifie|autorise|accorde)\b"
SOURCE_NORMS = ("doit", "doivent", "est tenu de", "sont tenus de", "interdit", "est interdit", "sont interdits", "sera tenu", "sera tenue", "doit etre", "doivent etre", "repond de", "responsable de", "s'imposent", "peut", "peuvent")
INVENTED_NORMS = ("doit", "doivent", "interdit", "est interdit", "sera tenu", "sera tenue", "repond de", "responsable de")
LEADING = (r"(?i)^\s*page\s+\d+\s*[-:–—]?\s*", r"(?i)^\s*(?:n[°o]\s*\d+\s*)?journal\s+officiel\s+de\s+la\s+r[ée]publique\s+tunisienne\s*[-:–—]?\s*", r"(?i)^\s*(?:art\.?|article)(?:\s*(?:n\s*)?(?:premier|1er|unique|\d+(?:[-.]\d+)*)\s*)?\s*[-:'’\"]+\s*")

# Confidence of a requirement.
CONFIDENT_TYPES = ("OBLIGATION", "INTERDICTION", "RESPONSABILITE", "EXCEPTION", "CONDITION", "DECLARATION", "CONTROLE", "REGISTRE")
CONFIDENT_NORMS = ("doit", "doivent", "interdit", "est interdit", "repond", "responsable", "sauf", "lorsque", "en cas de", "tenu de", "tenus de")

# Definitions and extensions of scope.
DEFINITION_STARTS = r"^\s*(on entend par\b|est consider|sont consider|ont consider|n'?est pas consider|ne sont pas consider|est reput|sont reput|est assimil|sont assimil|n'?est pas assimil|ne sont pas assimil|est un accord\b|est une convention\b)"
DEFINITION_NORMS = ("doit", "doivent", "est tenu de", "sont tenus de", "interdit", "est interdit", "sont interdits", "repond de", "responsable de", "est responsable de", "doit etre", "doivent etre", "sera", "seront")
UNIT_DEFINITIONS = r"\b(on entend par\b|est une convention\b|est un accord\b|est consider|sont consider|n'?est pas consider|ne sont pas consider|est reput|sont reput|est assimil|sont assimil|n'?est pas assimil|ne sont pas assimil)"
UNIT_NORMS = ("doit", "doivent", "est tenu de", "sont tenus de", "interdit", "est interdit", "sont interdits", "repond de", "responsable de", "est responsable de", "sera tenu", "peut", "peuvent", "beneficie", "prend en charge", "entraine", "fait foi", "fixe", "fixent")
CONCLUDED = ("conclu entre", "conclue entre")
EXTENSION_CONTEXT = ("les dispositions du present code sont etendues", "categories de travailleurs ci-apres", "personnes visees a l'alinea precedent")
EXTENSION_STARTS = r"^(les personnes qui|les personnes dont|lorsque ces personnes exercent leur profession|dans une entreprise industrielle ou commerciale|pour le compte d'une seule entreprise)"
EXTENSION_NORMS = ("sera toujours responsable", "ne sera responsable", "ne sont responsables", "est responsable", "sont responsables", "doit", "doivent", "interdit", "est interdit", "sont interdits", "tenu de", "tenus de", "peut", "peuvent", "beneficie", "prend en charge", "entraine", "fait foi", "fixe", "fixent", "est rejetee")
CLASSIFICATION = ("sont assimilees a", "est assimile a", "ne leur est applicable que dans la mesure ou", "sont etendues aux categories")

# Markers that single rules name.
RULE_MARKERS = ("chaque annee", "annuellement", "declar", "controle", "registre", "avis doit indiquer", "exemplaire", "a la disposition", "cahier des charges", "modalites", "transport", "societe communautaire", "societes communautaires", "compose de", "composee de", "composees de", "anciennete", "grade", "plus age", "champ d'application", "appelee", "s'engage a", "est un accord", "est une convention")

#: The groups whose markers are looked for together.
MARKER_GROUPS = (
    "RESPONSIBILITY", "EXCEPTION", "INTERDICTION", "CONDITION", "OBLIGATION", "DECLARATION", "REPORTING_VERB", "REPORTING_TARGET", "REPORTING_PAYLOAD", "ELIGIBLE", "ELIGIBLE_BY", "EFFECT", "EFFECT_OF_CONDITION", "REGISTER",
    "DOMAIN_NOISE", "INSTITUTIONS", "RECRUITING", "DOCUMENTS", "HARD_INTERDICTION", "CONDITION_OF_RIGHT", "OBLIGATION_CLAUSE", "CONDITION_CLAUSE", "ORGANISING", "CONTROLLING", "ANSWERING", "SUB_DOMAINS",
    "MISSING_CONDITION", "MISSING_SCOPE", "SUBJECTS", "GENERAL_NORMS", "RISK", "ACT_MARKERS", "INSTITUTIONAL_SUBJECTS", "INSTITUTIONAL_CUES", "SCOPE_OF_APPLICATION", "SCOPE_SOURCES", "SCOPE_NORMS", "SOURCE_NORMS", "INVENTED_NORMS", "CONFIDENT_NORMS",
    "DEFINITION_NORMS", "UNIT_NORMS", "CONCLUDED", "EXTENSION_CONTEXT", "EXTENSION_NORMS", "CLASSIFICATION", "RULE_MARKERS",
)

ACT_TYPES = (("ARRETE", r"arr[êe]t[ée]"), ("DECRET", "d[ée]cret"), ("LOI", "loi"))

# Families of errors: fix, and the rules that name them: family, action, severity.
FAMILY_FIX = {
    "STRUCTURAL_FUSION": "RETRY_SPLIT",
    "SNIPPET_TRUNCATION": "REBUILD_SNIPPET",
    "MISSING_COMPONENT": "REGROUND_FROM_SOURCE",
    "WEAK_GROUNDING": "REGROUND_FROM_SOURCE",
    "TYPE_DRIFT": "RETYPE_FROM_SOURCE",
    "SUBJECT_DRIFT": "RESUBJECT_FROM_CONTEXT",
    "HUMAN_EDIT_REWRITE": "REWRITE_FROM_HUMAN_FEEDBACK",
    "DUPLICATE_REGISTRY_ENTRY": "DEDUP_BEFORE_PROMOTE",
    "OUT_OF_SCOPE_HUMAN_REJECT": "DROP_OR_VALIDATE",
    "NORMATIVE_STRENGTH_DRIFT": "RETYPE_FROM_SOURCE",
}
OBSERVED_FILTERS = ("LOW_VALUE", "NON_ACTIONABLE_SCOPE", "INVENTED_NON_NORMATIVE", "OUT_OF_SCOPE_INDIVIDUAL", "POSTCALL_RUNTIME")
OBSERVED_REASONS = ("DESCRIPTIVE_WITHOUT_NORMATIVE_MARKER", "OUT_OF_SCOPE_INDIVIDUAL_ACT", "OUT_OF_SCOPE_PUBLICATION")

# Applicability without a model. Patterns and words are for text without accents.
_STAFF = r"\s*(\d{1,4})\s*(?:salaries?|employes?|travailleurs?)"
HEADCOUNT_MIN = (
    r"(?:au moins|min(?:imum)?|plus de|sup(?:erieur)?\s*(?:a|a\W)|>=?)" + _STAFF,
    r"(\d{1,4})\s*(?:salaries?|employes?|travailleurs?)\s*(?:et plus|ou plus)",
)
HEADCOUNT_MAX = (r"(?:moins de|inferieur(?:e)?\s*(?:a|a\W)|<=?|au plus|max(?:imum)?)" + _STAFF,)
SECTORS = (
    ("TEXTILE", ("textile", "habillement", "filature", "tissage", "confection")),
    ("CHIMIQUE", ("chimique", "petrochim", "solvant", "engrais", "pesticide")),
    ("AGROALIMENTAIRE", ("agroaliment", "alimentaire", "abattoir", "laitier", "conserverie")),
    ("CONSTRUCTION", ("chantier", "construction", "btp", "travaux publics", "batiment")),
    ("TRANSPORT", ("transport", "logistique", "routier", "ferroviaire", "maritime", "aerien")),
    ("SANTE", ("hopital", "clinique", "medical", "sante")),
    ("EDUCATION", ("ecole", "universite", "enseignement", "etablissement scolaire")),
)
SECTOR_SCOPE = ("secteur", "entreprises de", "entreprises du", "etablissements de", "etablissements du")
CHEMICAL = ("substance dangereuse", "substances dangereuses", "produits chimiques", "produit chimique", "fiche de donnees de securite", "fds", "solvant", "acide", "toxique", "inflammable", "corrosif")
ACTIVITY_THEMES = (
    ("TRAVAUX_EN_HAUTEUR", ("travaux en hauteur", "echafaud", "harnais", "ligne de vie", "nacelle"), ("hauteur", "echafaud", "harnais", "nacelle")),
    ("LEVAGE_MANUTENTION", ("levage", "grue", "pont roulant", "chariot elevateur", "transpalette"), ("grue", "pont roulant", "chariot", "transpalette", "levage")),
    ("PRESSION_CHAUDIERE", ("chaudiere", "equipement sous pression", "compresseur"), ("chaudiere", "compresseur", "pression")),
)
PUBLIC_ACTORS = ("le ministre", "la ministre", "le ministere", "le secretaire d'etat", "la direction generale", "la direction regionale", "la direction", "le chef de l'inspection", "l'inspection du travail", "le president du conseil de prud'hommes", "le conseil de prud'hommes", "les tribunaux", "le tribunal", "les juridictions", "la juridiction", "les services competents", "les syndicats", "le syndicat")
PRIVATE_ACTORS = ("entreprise", "employeur", "etablissement", "exploitant", "societe", "organisme")
