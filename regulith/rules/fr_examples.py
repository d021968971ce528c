"""Sentences of our own that reach the branches of the requirement rules: what the queries over the given tables' keys read."""

#: Requirement, citation, type that a model gives, expected type. The tables fill {n} and {a}.
SENTENCES = (
    ("L'employeur répond de tout dommage causé par ses machines.", "", "OBLIGATION", "RESPONSABILITE"),
    ("Le transport est permis, sauf autorisation refusée par le ministre.", "", "OBLIGATION", "EXCEPTION"),
    ("Il est interdit de fumer dans les ateliers de peinture.", "", "OBLIGATION", "INTERDICTION"),
    ("L'exploitant tient un registre numéroté et paraphé des déchets.", "", "AUTRE", "REGISTRE"),
    ("L'employeur doit déclarer tout accident du travail sous deux jours.", "", "OBLIGATION", "DECLARATION"),
    ("Les entreprises communiquent leurs données au ministère.", "", "OBLIGATION", "DECLARATION"),
    ("Le candidat titulaire d'une licence peut participer au concours.", "", "OBLIGATION", "CONDITION"),
    ("La caisse prend en charge les frais de transport des agents.", "", "AUTRE", "OBLIGATION"),
    ("En cas de fermeture, le travailleur bénéficie d'une prime.", "", "AUTRE", "CONDITION"),
    ("Lorsque la machine tourne, le capot reste fermé par le conducteur.", "", "AUTRE", "CONDITION"),
    ("L'exploitant doit nettoyer les bassins chaque semaine.", "", "AUTRE", "OBLIGATION"),
    ("Le contrôle des réservoirs revient aux agents du service.", "", "AUTRE", "CONTROLE"),
    ("Un exemplaire du plan est mis à la disposition du personnel.", "", "AUTRE", "OBLIGATION"),
    ("La couleur des murs peut changer selon les saisons.", "", "BAN", "INTERDICTION"),
    ("La commission est composée de cinq membres nommés pour trois ans.", "", "OTHER", "AUTRE"),
    ("Le jury est chargé de classer les offres reçues.", "", "RESPONSIBILITY", "RESPONSABILITE"),
    ("Les pièces justificatives sont jointes au formulaire de demande.", "", "AUTRE", "AUTRE"),
    ("Le présent décret sera publié au recueil des textes officiels.", "", "AUTRE", "AUTRE"),
    ("Monsieur Salah est nommé directeur du bureau régional.", "", "AUTRE", "AUTRE"),
    ("registre", "", "REGISTER", "REGISTRE"),
    ("Le salarié doit porter son casque en tout lieu.", "L'employeur fournit les casques aux équipes.", "OBLIGATION", "OBLIGATION"),
    ("L'employeur doit éclairer les voies de passage.", "L'employeur doit éclairer les voies de passage dans les locaux.", "OBLIGATION", "OBLIGATION"),
    ("L'exploitant doit arrêter le four sans délai.", "L'exploitant doit arrêter le four lorsque la pression monte.", "OBLIGATION", "OBLIGATION"),
    ("Sauf accord écrit, le délai est de dix jours ouvrables.", "", "OBLIGATION", "EXCEPTION"),
    ("et de fournir les moyens est une tâche commune.", "", "AUTRE", "AUTRE"),
    ("Est puni d'une amende quiconque vend ces produits.", "", "PROHIBITION", "INTERDICTION"),
    ("Le plan de prévention et l'évaluation des risques sont revus.", "", "CONTROL", "CONTROLE"),
    ("Conformément aux dispositions de l'article 12, l'avis est rendu.", "", "AUTRE", "AUTRE"),
    ("Sauf accord écrit du bailleur, le délai est de dix jours ouvrables.", "", "OBLIGATION", "EXCEPTION"),
    ("Sauf retard du train numéro {n}, sans autre avis.", "Le voyageur de la ligne {a} garde sa place, sauf retard du train numéro {n}, sans autre avis.", "EXCEPTION", "EXCEPTION"),
    ("L'exploitant doit afficher la liste {n} dans la salle commune.", "La salle commune est ouverte le lundi.", "OBLIGATION", "OBLIGATION"),
    ("Et doit amende de {n} dinars.", "", "AUTRE", "OBLIGATION"),
    ("Les documents du guichet est remis le {n} du mois.", "", "AUTRE", "AUTRE"),
    ("Le registre des bassins sont remis le {n} du mois.", "", "AUTRE", "AUTRE"),
    ("Monsieur Salah est nommé membre de la commission du concours.", "", "AUTRE", "AUTRE"),
    ("Le champ d'application est celui des quais de la zone {n}.", "En ce qui concerne les quais, les règles de la zone {n} valent.", "AUTRE", "AUTRE"),
    ("On entend par quai toute aire de pose de {n} mètres.", "", "AUTRE", "AUTRE"),
    ("Les personnes qui vendent des fruits au marché {n}.", "Les dispositions du présent code sont étendues aux catégories de travailleurs ci-après.", "AUTRE", "AUTRE"),
    ("L'employeur est tenu d'informer", "L'employeur est tenu d'informer l'inspection dans un délai de {n} jours.", "OBLIGATION", "DECLARATION"),
    ("Le directeur doit fixer les tarifs et transmettre le rapport {n} au conseil.", "Dans le cadre de la zone {n}, le directeur doit fixer les tarifs et transmettre le rapport.", "OBLIGATION", "DECLARATION"),
    ("Le prix du bail numéro {n} est fixé par", "Le prix du bail numéro {n} est fixé par arrêté, sauf accord du bailleur et en cas de vente.", "AUTRE", "EXCEPTION"),
    ("Article {a} - L'exploitant doit vider la cuve {n} conformément aux dispositions de la loi.", "Article {a} - L'exploitant doit vider la cuve {n}.", "OBLIGATION", "OBLIGATION"),
    ("Les conduites sont nettoyées. Le chef de quai doit tenir le registre {n} à jour.", "Le chef de quai doit tenir le registre {n} à jour, au titre de l'article {a}.", "OBLIGATION", "REGISTRE"),
    ("Le loueur ne peut vendre le bien {n} que par écrit devant notaire.", "Le loueur ne peut vendre le bien {n} que par écrit devant notaire.", "INTERDICTION", "INTERDICTION"),
    ("de l'eau claire dans la cuve {n} est la règle du quai.", "", "AUTRE", "AUTRE"),
    ("L'exploitant doit vider la cuve {n} - dans les ports, le chef est averti.", "L'exploitant doit vider la cuve {n}.", "OBLIGATION", "OBLIGATION"),
    ("L'employeur doit remettre au salarié le plan de la zone {n} en cas de travaux de nuit, sauf accord écrit.", "En cas de travaux de nuit, l'employeur doit remettre au salarié le plan de la zone {n}, sauf accord écrit.", "OBLIGATION", "EXCEPTION"),
    ("L'employeur doit remettre au salarié un plan écrit de la zone de pêche numéro {n}.", "L'employeur doit remettre au salarié un plan écrit de la zone de pêche numéro {n}.", "OBLIGATION", "OBLIGATION"),
    ("Le concours du port {n} est supervisé par un jury que le chef du port choisit.", "", "AUTRE", "AUTRE"),
    ("Le quai {n} est lavé par l'agent et est séché par le chef du port.", "Le quai {n} est lavé par l'agent, si le vent tombe, et est séché par le chef du port.", "AUTRE", "CONDITION"),
    ("Le directeur est chargé de classer les offres; de fixer le prix {n}; d) signer le bail du port.", "Le directeur est chargé de classer les offres; de fixer le prix {n}; d) signer le bail du port.", "AUTRE", "AUTRE"),
)

#: Questions of the chat.
QUESTIONS = ("Quel est le taux de conformité du site ?", "Combien de non-conformités sont ouvertes ?", "Nombre de preuves manquantes pour l'atelier", "Combien d'exigences applicables ne sont pas évaluées ?", "Quelles preuves sont insuffisantes ?", "Quels écarts faut-il traiter ?", "Que dit le code du travail ?", "Quelles actions pour corriger les points non conformes ?")

#: Acts of a gazette, one issue a text.
ISSUES = (
    "Décret n° 12-2020 du 3 mai\nArticle premier - L'exploitant doit nettoyer les bassins.\nArticle 2 - Le registre est tenu.\nArrêté du ministre du 4 mai\nArticle unique - Monsieur Salah est nommé directeur.",
    "Sommaire de la partie officielle, avec ses renvois\nArrêté du ministre du 5 mai fixant les modalités\nArticle premier - Les concours internes sont ouverts.\n",
    "Un texte sans acte, qui parle seulement du temps qu'il fait.",
    "Loi n° 7-2021 du 1er juin\nDécret n° 8-2021 du 2 juin\nArticle premier - La taxe est due chaque année.\nArrêté du 9 juin\nArticle unique - Madame Leila est chargée de fonctions de chef de service.",
)

#: Requirements that applicability is decided on, and companies: sector, substances, activities and equipment.
APPLICABLE = (
    "Les établissements employant au moins 40 salariés doivent créer un comité de sécurité.",
    "Toute entreprise de 300 travailleurs ou plus doit employer un médecin.",
    "Les ateliers de moins de 50 employés peuvent tenir un registre simple.",
    "Les entreprises du secteur textile doivent filtrer l'air des salles.",
    "L'employeur doit garder la fiche de données de sécurité de chaque solvant.",
    "Le port du harnais est obligatoire sur tout échafaudage.",
    "Les chariots et toute grue doivent être vérifiés chaque année.",
    "Le compresseur doit avoir une soupape réglée.",
    "Le ministre fixe la liste des postes. L'employeur la consulte.",
    "La direction régionale informe l'employeur de la date.",
    "Le sol des locaux doit rester propre.",
)
COMPANIES = (("Filature et tissage", "", "montage à grande hauteur"), ("Transport routier", "acide de batterie", "deux grues et un pont roulant"), ("", "", "compresseur d'atelier"), ("Conseil", "produits chimiques", ""))
