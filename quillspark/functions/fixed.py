"""Values that must equal the reference's for right results."""

from __future__ import annotations


def _phrases(text: str) -> tuple[str, ...]:
    return tuple(" ".join(x.split()) for x in text.split(","))


# Keywords for datasets, in the order of their ranks.
DATA_PHRASES = _phrases(
    """
    abdominal ct, acquisitions, angiogram, angiograms, archive, archives, biobank, biobanks, biorepository, biorepositories, cancer registry, cancer
    registries, case study, case studies, catalog, catalogs, catalogue, catalogues, chart, charts, chest computed tomography, clinical data, clinical
    study, clinical studies, clinical trial, clinical trials, collection, collections, compendium, compilation, compilations, computed tomogram,
    computed tomograms, computed tomographies, computed tomography, computed tomography scan, computer tomography, computer tomographies, computerized
    tomography, computerized tomographies, computerized tomography ct, contrast enhanced computed tomography, corpora, corpus, ct image, ct images, ct
    scan, ct scans, data, data analysis, data base, data bases, data lake, data lakes, data set, data sets, data warehouse, data warehouses,
    data-bank, data-banks, data-base, data-bases, data-lake, data-lakes, data-set, data-sets, databanks, database, databases, datalake, datalakes,
    dataset, datasets, descriptive analysis, descriptive study, descriptive studies, diaries, diary, dump, dumps, ehr, electronic health record,
    electronic health records, electronic medical record, electronic medical records, electronic patient record, electronic patient records,
    experimental study, experimental studies, feasibility trial, feasibility trials, health record, health records, historical data, hologram,
    holograms, hospital episode statistics, hospital record, hospital records, household survey, household surveys, image, images, interview,
    interviews, knowledge base, knowledge bases, knowledgebase, knowledgebases, magnetic resonance image, magnetic resonance images, manuscript,
    manuscripts, medical record, medical records, memo, memos, mri, mris, narrative review, national database, national databases, national survey,
    national surveys, neurological examination, neurological examinations, observational data, online survey, online surveys, patient registry,
    patient registries, patient survey, patient surveys, pilot study, pilot studies, population data, qualitative analysis, questionnaire,
    questionnaires, radiation hybrid mapping, radiation hybrid mappings, radiograph, radiographs, randomised controlled trial, randomised controlled
    trials, randomised trial, randomised trials, randomized control trial, randomized control trials, randomized controlled trial rct, randomized
    study, randomized studies, randomized trial, randomized trials, rct, record, records, registry, registries, repo, repos, repositories, repository,
    scan, scans, segmentation, segmentations, self report, self reports, sonogram, sonograms, spatial statistics, stereogram, stereograms, survey,
    survey data, surveys, t mri, taxonomy, taxonomies, tomogram, tomograms, treatment study, treatment studies, trial, trials, ultrasound scan,
    ultrasound scans, validation study, validation studies
    """
)

# Keywords for software, in the order of their ranks.
SOFTWARE_PHRASES = _phrases(
    """
    adware, algorithm, algorithms, api, apis, app, application, applications, approach, approaches, apps, component, components, courseware, freeware,
    function, functions, groupware, gui, guis, interface, interfaces, libraries, library, malware, mechanism, mechanisms, method, methodologies,
    methodology, methods, middleware, model, models, module, modules, netware, procedure, procedures, process, processes, program, programme,
    programmes, programs, routine, routines, script, scripts, shareware, software, spyware, system, systems, technique, techniques, tool, toolkit,
    toolkits, tools, vaporware, vapourware, widget, widgets
    """
)

# Words that make a bracketed name and number no citation.
CITATION_STOPWORDS = _phrases(
    """
    leg, legend, tab, tabs, table, tables, fig, figs, figure, figures, note, notes, sup, suppl, supplementary, app, appx, append, appendix, ver, version,
    footnote, see, sec, section, cohort, ext, extended, additional
    """
)

# Hosts of code repositories.
CODE_HOSTS = ("github", "gitlab", "bitbucket", "sourceforge", "launchpad", "cloud.google", "aws.amazon", "phabricator", "phacility", "gogs", "gitea", "allura")

# Kinds of candidates in their order, the type each stands for, and the gazetteer type of each type name.
KINDS = ("dataset", "software", "gaz_dataset", "gaz_method")
TYPE_OF_KIND = {"dataset": "dataset", "software": "software", "gaz_dataset": "dataset", "gaz_method": "software"}
GAZETTEER_TYPE = {"dataset": "Dataset", "software": "Method", "repository": "Dataset", "method": "Method"}

# Questions to a scorer; {t} is the type.
QUESTIONS = {
    "artifact": "Is there a valid {t} defined in the <m> and </m> tags?",
    "name": "What is the name of the {t} defined in the <m> and </m> tags?",
    "license": "What is the license of the {t} defined in the <m> and </m> tags?",
    "version": "What is the version of the {t} defined in the <m> and </m> tags?",
    "url": "What is the URL of the {t} defined in the <m> and </m> tags?",
    "ownership": "Is the {t} defined in the <m> and </m> tags introduced or created by the authors of the publication in the snippet above?",
    "reuse": "Is the {t} defined in the <m> and </m> tags used or adopted by the authors of the publication in the snippet above?",
    "list": "List all artifacts in the above snippet.",
}

# Gazetteer keys that are noise.
NOISE_KEYS = ("0", ".", "2048")
MISSING = "N/A"

#: Patterns of citation marks (fixed values).
CITATION_PATTERNS = {
    "m0": r"[\[(][^\]\[)(]*?et al.*?(?:\]|\)|$)",
    "m1": r"\[\s*\d+\s*(?!\s*(?:\w|[^\w,\-\]])|\s*,\d+(?:[^\w,\-\]]))\s*?(?:\]|$)",
    "m1b": r"\[\s*[A-Z](?:\w+\s+(?:\&\s+)?){1,}\d+\s*(?:\]|$)",
    "m2": r"\(\s*\d+\s*(?!\s*(?:\w|[^\w,\-\)])|\s*,\d+(?:[^\w,\-\)]))\s*?(?:\)|$)",
    "m2b": r"\(\s*[A-Z](?:\w+\s+(?:\&\s+)?){1,}\d+\s*(?:\)|$)",
}

#: Beginnings of what looks like a URL and is none (fixed values).
URL_NOISE = ("i.e", "et.al", "e.g", "al.")
