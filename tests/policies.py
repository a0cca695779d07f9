"""Three short specifications and the rules they are read by."""

SPECS = {
    "aurora": ("R$ 50.000.000,00", "R$ 250.000,00", "ilimitada", "Contratada", "R$ 5.000.000,00", "Prazo complementar: 12 (doze) meses"),
    "boreal": ("R$ 30 milhões", "R$ 500 mil", "01/10/2020", "Não contratada", "-", "Prazo complementar: 6 (seis) meses"),
    "cruzeiro": ("R$ 40.000.000,00", "R$ 100.000,00", "01/10/2016", "Contratada", "R$ 2.000.000,00", "Sem prazo adicional."),
}


def page(limit, deductible, since, status, amount, span):
    return (
        "DOCUMENTO FICTÍCIO\nESPECIFICAÇÃO DA APÓLICE\n"
        f"Limite Máximo de Garantia: {limit}\nFranquia\npor reclamação:\n{deductible}\nData de Retroatividade: {since}\n"
        f"Penhora online\n{status}\n{amount}\n{span}\n"
    )


PAGES = [(doc, n, text, True) for doc, values in SPECS.items() for n, text in ((1, page(*values)), (2, "Observações: o tomador declara conhecer as condições."))]
PAGES_SCHEMA = "doc_id string, page_no int, text string, is_synthetic boolean"

CAMPOS = {
    "campos": [
        {"id": "limite", "grupo": "limites", "rotulo": "Limite", "tipo": "dinheiro", "onde": "espec", "pistas": ["limite máximo"], "rotulos_espec": ["Limite Máximo de Garantia"]},
        {"id": "franquia", "grupo": "limites", "rotulo": "Franquia", "tipo": "dinheiro", "onde": "espec", "pistas": ["franquia", "reclamação"], "rotulos_espec": ["Franquia por reclamação"]},
        {"id": "retroatividade", "grupo": "gatilho", "rotulo": "Retroatividade", "tipo": "data", "onde": "espec", "pistas": ["retroatividade"], "rotulos_espec": ["Data de Retroatividade"]},
        {"id": "penhora", "grupo": "coberturas", "rotulo": "Penhora online", "tipo": "cobertura", "onde": "ambos", "pistas": ["penhora"]},
        {"id": "sublimite", "grupo": "limites", "rotulo": "Sublimite", "tipo": "dinheiro", "onde": "espec", "pistas": ["penhora"], "linha_tabela": "penhora online"},
        {"id": "prazo", "grupo": "gatilho", "rotulo": "Prazo complementar", "tipo": "duracao", "onde": "ambos", "pistas": ["prazo complementar"]},
        {"id": "custos", "grupo": "geral", "rotulo": "Custos", "tipo": "enum", "onde": "cg", "pistas": ["custos"], "valores": {"dentro": "dentro"}},
    ]
}
EXTRACAO = {
    "enums": {"custos": {"regras": [{"valor": "dentro", "regex": "custos dentro do limite"}]}},
    "booleanos": {},
    "duracoes": {"prazo": {"regras": [{"extrair": True, "regex": r"prazo complementar: [0-9]{1,3} \([a-z ]+\) meses"}]}},
    "coberturas": {
        "penhora": {"titulo": "penhora", "linha_espec": "penhora online"}, "escopo_basico": "riscos cobertos", "marcador_adicional": "cobertura adicional",
        "texto_basico": {}, "exclusao_geral": {},
    },
    "exclusoes": {"escopo_titulo": "exclusoes", "titulo_opcional": "clausula particular de exclusao", "ressalva": "salvo", "temas": {"cibernetica": "virus"}},
}
COERENCIA = {"por_tipo": {"cobertura": {"contratada": "contratad", "nao_contratada": "nao contratad"}}, "por_campo": {}}
COMPARACAO = {
    "regras": [
        {"id": "R1", "campo": "limite", "criterio": "maior_melhor", "fundamento": "maior protege mais"},
        {"id": "R2", "campo": "franquia", "criterio": "menor_melhor"},
        {"id": "R3", "campo": "retroatividade", "criterio": "retroatividade"},
        {"id": "R4", "campo": "penhora", "criterio": "ordem", "ordem": [["contratada"], ["nao_contratada", "nao_prevista"]], "ausente_como": "nao_prevista"},
        {"id": "R5", "campo": "sublimite", "criterio": "maior_melhor"},
        {"id": "R6", "campo": "prazo", "criterio": "maior_melhor"},
    ]
}
CONFORMIDADE = {
    "norma_padrao": "Norma 1",
    "regras": [
        {"id": "prazo-ausente", "aplica_a": "especificacao", "artigo": "art. 19", "severidade": "atencao", "mensagem": "Sem prazo.", "condicoes": [{"campo_ausente": "prazo"}, {"texto_ausente": "prazo complementar"}]},
        {"id": "observacoes", "aplica_a": "todos", "artigo": "art. 2", "severidade": "informativo", "mensagem": "Ver.", "condicoes": [{"texto_presente": "tomador declara"}]},
    ],
}
