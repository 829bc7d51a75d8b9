"""Kind rules: (language, kind, pattern over normalised text), in order of preference."""

# fixed values: patterns that name the kind of a document
RULES = (
    ("pt", "contrato", r"\bextrato (do|de) (contrato|termo|aditivo)|\btermo aditivo\b|\bcontrato\b"),
    ("pt", "nota_fiscal", r"\bnota fiscal\b|\bnfs? e\b|\bdanfe\b|\bcupom fiscal\b"),
    ("pt", "recibo", r"\brecibo\b"),
    ("pt", "fatura_boleto", r"\bfatura\b|\bboleto\b|\blinha digitavel\b|\bconta de (energia|agua|luz|gas)\b"),
    ("pt", "extrato", r"\bextrato (bancario|de conta|mensal)\b|\bsaldo anterior\b"),
    ("pt", "ata", r"^ata\b|\bata d[aeo]s?\b"),
    ("pt", "anotacoes", r"^(anotacoes|notas|lista|lembretes?)\b"),
    ("pt", "edital", r"\bedital\b|\bpregao\b|\bchamamento publico\b"),
    ("pt", "ato_normativo", r"\b(portaria|decreto|resolucao|instrucao normativa|lei)( [a-z]+)? n[o ]|\bpolitica de\b"),
    ("pt", "parecer", r"\bparecer\b|\bnota tecnica\b|\blaudo tecnico\b"),
    ("pt", "saude", r"\breceita\b|\bhemograma\b|\batestado medico\b|\bcrm\b|\bexame\b"),
    ("pt", "declaracao_certidao", r"\bdeclar(o|acao)\b|\bcertidao\b|\batestado\b"),
    ("pt", "relatorio", r"\brelatorio\b"),
    ("pt", "oficio_carta", r"\boficio\b|\brequerimento\b|\bmemorando\b|^prezad|^carta\b"),
    ("pt", "email", r"^de \S+.*\b(para|assunto)\b|\bassunto\b.*\benviado\b"),
    ("pt", "curriculo", r"\bcurriculo\b|\bexperiencia profissional\b"),
    ("pt", "manual", r"\bmanual\b|\binstrucoes de uso\b"),
    ("pt", "orcamento", r"\borcamento\b|\bproposta comercial\b"),
    ("pt", "artigo", r"\bresumo\b.*\bmetodologia\b|\babstract\b"),
    ("en", "contrato", r"\b(contract|lease|rental agreement|service agreement|purchase agreement)\b"),
    ("en", "fatura_boleto", r"\b(utility|electricity|water|gas|phone) bill\b|\bamount due\b"),
    ("en", "nota_fiscal", r"\b(tax )?invoice\b"),
    ("en", "recibo", r"\breceipt\b"),
    ("en", "extrato", r"\b(bank|account) statement\b|\bstatement of account\b"),
    ("en", "ata", r"^minutes\b|\bminutes of\b|\bmeeting minutes\b"),
    ("en", "ato_normativo", r"\b(executive order|ordinance|final rule|proposed rule|interim rule|public law)\b|\bregulation (no|number)\b"),
    ("en", "edital", r"\brequest for (proposals|applications|quotations)\b|\binvitation to bid\b|\bcall for (proposals|applications|tenders)\b|\bnotice of funding\b|\bsolicitation\b"),
    ("en", "parecer", r"\b(legal|advisory|expert) opinion\b|\btechnical (note|opinion)\b"),
    ("en", "saude", r"\bprescription\b|\bmedical certificate\b|\blab(oratory)? (results|report)\b|\bblood test\b"),
    ("en", "declaracao_certidao", r"\b(certificate|certification|affidavit|attestation)\b"),
    ("en", "relatorio", r"\breport\b"),
    ("en", "oficio_carta", r"^dear\b|\bmemorandum\b|\bmemo\b"),
    ("en", "email", r"^from \S+.*\b(to|subject)\b|\bsubject\b.*\bsent\b"),
    ("en", "curriculo", r"\bresume\b|\bcurriculum vitae\b|\bwork experience\b"),
    ("en", "manual", r"\buser (manual|guide)\b|\bquick start\b|\binstruction manual\b"),
    ("en", "orcamento", r"\b(quote|quotation|estimate)\b"),
    ("en", "anotacoes", r"^(notes|to do|todo|shopping list)\b"),
    ("es", "contrato", r"\bcontrato\b"),
    ("es", "fatura_boleto", r"\b(recibo|factura) de (luz|agua|gas|telefono)\b"),
    ("es", "nota_fiscal", r"\bfactura\b"),
    ("es", "extrato", r"\bextracto (bancario|de cuenta)\b"),
    ("es", "ata", r"^acta\b|\bacta d[eo]\b"),
    ("es", "ato_normativo", r"\b(real decreto|decreto|resolucion|ley|reglamento|ordenanza)( [a-z]+)? \d|\borden [a-z]{2,5} \d"),
    ("es", "edital", r"\blicitacion\b|\bconvocatoria\b|\bpliego\b"),
    ("es", "parecer", r"\bdictamen\b|\binforme tecnico\b"),
    ("es", "saude", r"\breceta\b|\brecetario\b|\banalisis clinicos\b|\bcertificado medico\b"),
    ("es", "declaracao_certidao", r"\bcertificado\b|\bcertificacion\b|\bdeclaracion jurada\b|\bconstancia\b"),
    ("es", "relatorio", r"\binforme\b|\bmemoria anual\b"),
    ("es", "oficio_carta", r"\boficio\b|\bsolicitud\b|^estimad[oa]s?\b|\bmemorando\b"),
    ("es", "email", r"^de \S+.*\b(para|asunto)\b"),
    ("es", "curriculo", r"\bcurriculum\b|\bhoja de vida\b|\bexperiencia (laboral|profesional)\b"),
    ("es", "manual", r"\bmanual\b|\binstrucciones\b"),
    ("es", "orcamento", r"\bpresupuesto\b|\bcotizacion\b"),
    ("es", "artigo", r"\bresumen\b.*\bmetodologia\b"),
    ("es", "anotacoes", r"^(notas|apuntes)\b"),
)
