"""Marked sentences from a small grammar, from which the segment model of :mod:`personal` is trained.

A rule's alternatives hold ``<rule>`` references and ``{type}`` value slots; everything outside slots is not a
personal detail. Alternatives are split into two parts by their place in the list: the training part and the part
held out, so held-out carriers share no alternative of four or more with those trained on. Values are drawn from a
seeded generator. No sentence is taken from any table; a test looks every carrier up in the tables.
"""

from __future__ import annotations

import functools
import random
import re
import unicodedata

#: The grammar; alternatives are parted by `|`.
_RULES = """
kin = minha tia|meu avô|minha prima|meu genro|minha sogra|meu cunhado|a minha nora|meu padrasto|minha madrinha|meu sobrinho|minha colega|meu patrão
post = a síndica|o zelador|a enfermeira|o sargento|a recepcionista|o frentista|a gerente|o mecânico|a perita|o entregador|o inspetor|a escrivã
honor = sr.|sra.|dona|seu|dr.|dra.|doutora|senhor|Sr.|Sra.|D.|Dr.
did = chegou depois|ficou de ligar|presenciou a cena|pagou o reboque|trouxe as chaves|gravou um vídeo|prestou socorro|assumiu a culpa|fugiu a pé|chamou a polícia|assinou o recibo|discutiu comigo|pode confirmar isso|guardou os pedaços|estava ao volante|ia de carona|mora ao lado|tirou as fotos
whois = a condutora era|o passageiro era|a dona do veículo é|o nome dele é|quem bateu foi|quem recebeu o carro foi|o culpado seria|a segunda testemunha é|o beneficiário passa a ser|quem assina embaixo é|meu nome completo é|eu me chamo|quem vai buscar é|a outra parte é|o inquilino é|aqui quem fala é
reach = procurem|avisem|tratar com|perguntem a|entreguei a pasta a|passei o volante para|combinei tudo com|mandem a carta a|vendi a moto para|fui socorrida por|recebi a visita de|autorizo|falei ontem com|o contrato está com|registrado por|comprado de
close = Abraço|Cordialmente|Sem mais|Obrigado|Obrigada|Respeitosamente|Agradecido|Saudações|Ciente|De acordo|Declarante|Solicitante|Requerente|Proponente
after = no fim da tarde|hoje cedo|numa segunda visita|se for preciso|no plantão|em horário comercial|até sexta|por gentileza|quando puderem|sem falta
titled = <doc> veio em nome de {name}.|o carnê está em nome de {name}.|emitam em nome de {name}.|o seguro consta em nome de {name}, <post>.|reserva feita em nome de {name}.
verb2 = aguardo|sigo firme|falo por todos|moro longe|não desisto|peço pressa|estou de férias|volto logo
verb = Conheço|Represento|Encontrei|Chamem|Avisei|Indico|Nomeio|Ouçam|Era|Foi|Vi|Citei|Liberem|Processo|Autorizem|Convoquem|Falou|Assina|Sou|Procurem a|Agradeço a|Devolvam a|Respondam a|Contratei
named = <verb> {name}.|<verb> {name} <after>.|<verb> {name}, <post>.|<verb> {name} e <verb2>.|<whois> {name}.|<reach> {name}.|<reach> {name} <after>.|<kin> {name} <did>.|<post> {name} <did>.|<honor> {name} <did>.|{name} <did>.|{name}, <kin>, <did>.|<kin>, {name}, <did>.|<post>, {name}, <did>.|<close>, {name}|<close>: {name}|<close>, {name}.|<kin> {name} e <post> {name} vieram.|{name} e {name} <did>.|<whois> {name}, <post>.
ring = disquem|retornem para|meu fone|whats|contato por|celular novo|fixo|ramal direto|o telefone dela é|chamem no|mandem mensagem ao|ligações só em|o dele é|outro número|recados em|fone de casa|o da minha irmã é|atendo em|fiquei com o número|me achem no
hours = após o almoço|só à tarde|o dia inteiro|exceto domingo|até as 20h|de manhã|nos fins de semana|a qualquer hora
phoned = <ring> {phone}.|<ring>: {phone}|<ring> {phone}, <hours>.|<ring> {phone} ou no escritório.|{phone}, <hours>.|{phone} (<hours>).|<ring> {phone} e falem com {name}.|<ring> {phone} com <post>.|telefonaram de {phone} sem deixar recado.|dei o {phone} a <post>.|fone {phone}|se eu não atender, usem {phone}.|anote aí {phone}.
proof = exibi|levei|consta|informo|apresentei|copiem|registrem|conferiram|anexei cópia de|perdi|renovei|só tinha|mostrou|o motorista portava|o cadastro traz|a ficha indica
held = desde 2010|na recepção|ao agente|na portaria|para conferência|com foto|sem rasura|junto com a conta|dentro da validade|por engano
proved = <proof> {id}.|<proof> {id} <held>.|<proof>: {id}|<kin> <proof> {id}.|{name}, {id}.|{name} ({id_bare}) <did>.|{id}, <held>.|{id} <held>.|o titular <proof> {id} <held>.|minha inscrição: {id_bare}.|sou {id_bare} no sistema.|<post> <proof> {id} <held>.|<whois> {name}, portador de {id}.|dados do titular: {id_bare}
car = o caminhão|a caminhonete|meu veículo|o táxi|a van|o reboque|a motocicleta|o utilitário|um hatch branco|uma picape|o fusca|a perua
went = deu ré|atravessou a faixa|parou no acostamento|perdeu o freio|entrou na contramão|sumiu na esquina|raspou o muro|foi apreendido|está na oficina|ficou sem luz
plated = <car> {plate} <went>.|<car>, {plate}, <went>.|<car> ({plate}) <went>.|<car> tem placa {plate}.|emplacado {plate}.|placas {plate}|<car> de placa {plate} <went>.|filmei a placa {plate}.|<proof> o documento do {plate}.|{plate} <went>.|era {plate}, acho.
lives = eu vivo na|a vistoria pode ser na|nosso endereço atual é|fica guardado na|mandem o perito para|o guincho vem até|a família reside em|correspondência:|o conserto será em|atendo vocês na|tudo ocorreu diante de|novo endereço:|a garagem alugada é na|recolham em|o depósito fica na|deixem na portaria de
near = perto do posto|ao lado do banco|casa amarela|portão verde|sobrado|segundo andar
lived = <lives> {street}.|<lives> {street}, <near>.|<kin> vive em {street}.|{name} mora na {street}.|{street}, <near>.|<lives> {street}|{street} é o local da vistoria.|<post> anotou {street}.|levem a {street} <after>.|meu domicílio: {street}.
write = escrevam a|o endereço eletrônico é|correio eletrônico:|usem|e-mail novo|mandei as fotos de|aguardo no|cadastrem|meu login é|encaminhem a|recebi de|outra caixa:|o perito usa|a nota vai para|respondo por|digitem
wrote = <write> {email}.|<write> {email} <after>.|<write>: {email}|{email} é o meu.|<write> {email} ou liguem {phone}.|<kin> usa {email}.|{name}, {email}.|a senha chegou em {email}.|não reconhecem {email} no aplicativo.|copiem {email} na mensagem.
when = anteontem|na volta do trabalho|de madrugada|durante a chuva|na hora do rush|no mês passado|em pleno feriadão|ao meio-dia|às {n1}h|às {n1}h{n2}|lá pelas {n1}h{n2}|desde as {n1}h{n2}|antes das {n1}h{n2}|a partir das {n1}h{n2}|no horário das {n1}h{n2}|em {date}|na data de {date}|o dia {date}|desde {date}|ainda em {date}|no início da noite|há três semanas
place = na ponte|no túnel|no pedágio|na saída do estádio|diante da padaria|no estacionamento do shopping|na estrada de terra|na rotatória|na {streetname}|perto da {streetname}|na esquina da {streetname}|na altura do km {n3}|em {Place}|no centro de {Place}|na subida de {Place}|na praia|no trevo de {Place}|na feira de {Place}|nas curvas de {Place}|vindo de {Place}|na divisa de {Place}|no bairro de {Place}|perto de {Place}|no terminal de {Place}|na zona sul de {Place}|antes de {Place}
event = derrapei no óleo|bati num poste|o capô se abriu|um galho riscou a pintura|quebraram meu retrovisor|arrombaram a porta|furtaram as rodas|a bateria pifou|o freio falhou|o granizo amassou o teto|caí num buraco|um cachorro cruzou a pista|o airbag disparou|fecharam minha frente|pegou fogo no motor
loss = gastei R$ {n3},{n2}|pediram R$ {n2}.{n3f},{n2} de conserto|paguei a diária|fiquei a pé {n2} dias|o orçamento deu R$ {n4},00|faltam peças|ninguém se feriu|houve só susto|perdi um voo|faltei ao serviço
told = <when> <event> <place>.|<when>, <place>, <event>, e <loss>.|<event> <place> e <loss>.|<loss>.|<when> <car> <went>.|<car> <went> <place>.|<event>, mas <loss>.|<when>, <car> <went> e <loss>.
doc = a nota fiscal|o protocolo|o boleto|a fatura|o número do aviso|a ordem de serviço|o recibo|o chamado|o orçamento|a guia|o pedido|a proposta|o comprovante|nota|protocolo|fatura
number = {n6}|{n8}|{n9}|{n10}|{year}{n9}|{year}0{n8}|{n11}|{n13}|{year}{n6}
state = segue anexa|já venceu|foi emitida ontem|continua em aberto|está repetida|não abre|foi paga|saiu errada
counted = <doc> {number} <state>.|<doc> nº {number} <state>.|<doc> é {number}.|<doc> anterior: {number}.|<doc> {number} é da oficina.|registro policial {n5}/{year}.|boletim de ocorrência {n6}/{year} lavrado.|BO {n4}/{year} na delegacia.|código de barras {n47}.|boleto {n47} <state>.|linha digitável {n47}.|CNPJ {cnpj}.|a loja tem CNPJ {cnpj}.|CNPJ {n14} da transportadora.|processo {process}.|processo administrativo {process} em curso.|o produto tem processo {process}.|apólice {n3}-{n1}.|apólice número {n6}.|contrato {n2}-{n1} vence logo.|box {n2} do subsolo.|chassi final {n4}.|andei {n3} km.|sobraram {n2} parcelas.|<doc> de {date} <state>.
firm = {Firm}|a {Firm}|a funilaria {Surname}|o Auto Posto {Surname}|Irmãos {Surname}|Oficina {Surname}|a Transportadora {Surname}|Mecânica {Surname}|a locadora {Surname}|Guinchos {Surname}
firmed = <firm> <state2>.|fui até <firm>.|o atendente da {Firm} <state2>.|<firm> cobrou caro.|levei a <firm> <when>.|<car> é um {Model} azul.|tenho um {Model} preto.|aluguei um {Model}.|troquei por um {Model} novo.|meu {Model} <went>.|as peças vêm de {Place}.|saí de {Place} <when>.|a oficina de {Place} <state2>.|o prefeito de {Place} <state2>.|a loja é de {Place}.|moro em {Place}.|viajei a {Place} <when>.
state2 = não respondeu|pediu mais prazo|negou o serviço|fechou as portas|demorou demais|mandou o laudo|perdeu meu formulário|atende mal
streeted = <event> na {streetname}, sem placa.|a {streetname} estava alagada.|subi a {streetname} <when>.|entrei na {streetname} e <event>.|vim pela {streetname} devagar.|<car> <went> na {streetname}.|interditaram a {streetname}.|a {streetname} não tem calçada.|fica na Rua {fullname}, esquina.|parei na Avenida {fullname} um instante.
asked = alguém pode me orientar?|quero acompanhar o pedido.|quanto tempo leva?|está dentro da cobertura?|mandem o formulário certo.|cansei de esperar.|obrigado pela atenção.|reclamo do atraso.|sou cliente há anos.|peço a cópia do laudo.|sigo aguardando.|desculpem o incômodo.|já liguei quatro vezes.|o aplicativo travou.|preciso trabalhar com o carro.|qual oficina atende?
"""
#: Rules whose sentences hold details, and rules whose sentences hold none.
MARKED = ("named", "named", "named", "titled", "phoned", "phoned", "proved", "proved", "plated", "lived", "wrote")
UNMARKED = ("told", "told", "counted", "counted", "firmed", "streeted", "asked")
RULES = {line.split(" = ", 1)[0]: line.split(" = ", 1)[1].split("|") for line in _RULES.strip().split("\n")}
#: Common given and family names, beside which most names are made from syllables.
_GIVEN = "Maria José Ana João Antônio Francisco Carlos Paulo Pedro Lucas Luiz Marcos Rafael Daniel Bruno Eduardo Felipe Rodrigo Sandra Adriana Juliana Fernanda Patrícia Aline Camila Letícia Beatriz Sônia Vera Rosa".split()
_FAMILY = "Silva Santos Oliveira Souza Lima Pereira Ferreira Costa Rodrigues Almeida Nascimento Alves Carvalho Ribeiro Gomes Martins Rocha Barbosa Dias Moreira Cardoso Teixeira Correia Melo Cunha Pinto Nunes Mendes Freitas Vieira".split()
_ONSETS = "b c d f g j l m n p r s t v z br cl cr dr fl fr gl gr pl pr tr ch lh nh qu".split()
_VOWELS = "a e i o u a e i o ã é ó ú".split()
_CLOSES = ["", "", "", "l", "r", "s", "m", "n", "z"]
STREET_TYPES = "Rua R. Avenida Av. Travessa Tv. Alameda Al. Praça Estrada Rodovia Rod. Largo".split()
#: Words that place names begin with.
_PLACES = "Monte Morro Serra Vila Santa São Porto Campo Rio Lagoa Praia Jardim Parque Barra Ponte Nova Alto Ilha".split()
_HONOURED = "Doutor Professor Barão Major General Dona Padre São Marechal Engenheiro Coronel Visconde".split()


def alternatives(rule: str, held_out: bool) -> list[str]:
    """The alternatives of a rule for training, or those held out; rules of fewer than four are in both."""
    every = RULES[rule]
    return every if len(every) < 4 else [a for i, a in enumerate(every) if (i % 4 == 3) == held_out]


class Values:
    """Random slot values; ``proper`` collects the words that are written with a capital."""

    def __init__(self, rng: random.Random):
        self.rng, self.proper = rng, set()
        self.given = [*_GIVEN, *(self.word(rng.choice((2, 2, 3))) for _ in range(220))]
        self.surnames = [*_FAMILY, *(self.word(rng.choice((2, 3, 3, 4))) for _ in range(420))]
        self.proper |= {fold(w) for w in (*_GIVEN, *_FAMILY)}

    def word(self, syllables: int) -> str:
        r = self.rng
        got = "".join(r.choice(_ONSETS) + r.choice(_VOWELS) for _ in range(syllables)) + r.choice(_CLOSES)
        got = got[0].upper() + got[1:]
        self.proper.add(fold(got))
        return got

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def name(self, whole: bool = False) -> str:
        r, first, last = self.rng, self.rng.choice(self.given), self.rng.choice(self.surnames)
        kind = 0 if whole else r.random()
        if kind < 0.46:
            return f"{first} {last}"
        if kind < 0.58:
            return f"{first} {last} {r.choice(self.surnames)}"
        if kind < 0.72:
            return f"{first} {r.choice(['de', 'da', 'do', 'dos', 'das'])} {last}"
        if kind < 0.84:
            return f"{first} {r.choice(['de', 'da', 'do'])} {last} e {r.choice(self.surnames)}"
        if kind < 0.88:
            return f"{first} {r.choice(self.given)} {last} {r.choice(['de', 'da', 'dos'])} {r.choice(self.surnames)}"
        return f"{first} {last[0]}." if r.random() < 0.5 else f"{first} {r.choice(self.surnames)[0]}. {last}"

    def phone(self) -> str:
        a, b, c = self.digits(2), "9" + self.digits(4), self.digits(4)
        d = self.digits(4)
        return self.rng.choice([f"({a}) {b}-{c}", f"({a}) 9 {d} {c}", f"({a}){d}-{c}", f"+55 {a} {b}-{c}", f"+55{a}{b}{c}", f"{a} {b} {c}", f"{a} {b}-{c}", f"{a}.{b}.{c}", f"{a}{b}{c}", f"0{a} {b}-{c}", f"{b}-{c}", f"({a}) {d}-{c}"])

    def id_value(self) -> tuple[str, str]:
        a, b, c, d = self.digits(3), self.digits(3), self.digits(3), self.digits(2)
        rg = f"{self.digits(2)}.{self.digits(3)}.{self.digits(3)}-{self.rng.choice('0123456789X')}"
        cpf = self.rng.choice([a + b + c + d, f"{a}.{b}.{c}-{d}", f"{a} {b} {c} {d}", f"{a}.{b}.{c}/{d}", f"{a}{b}{c}-{d}"])
        cnh, plain_rg, passport = self.digits(11), self.digits(8) + "-" + self.digits(1), self.rng.choice("ABCFGYZ") + self.rng.choice("ABCDQWXY") + self.digits(6)
        r = self.rng
        kind = r.random()
        if kind < 0.5:
            return r.choice(["CPF ", "CPF nº ", "cpf: ", "CPF: ", "o CPF é ", "inscrição ", "documento ", "cadastro de pessoa física ", "registrado sob ", "inscrita sob o número "]), cpf
        if kind < 0.72:
            return r.choice(["RG ", "RG: ", "rg nº ", "identidade ", "a identidade é ", "carteira de identidade "]), r.choice([rg, plain_rg])
        if kind < 0.9:
            return r.choice(["CNH ", "CNH nº ", "habilitação ", "habilitação nº ", "carteira de motorista ", "registro de habilitação "]), cnh
        return r.choice(["passaporte ", "passaporte nº ", "meu passaporte: "]), passport

    def plate(self) -> str:
        a = "".join(self.rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(3))
        tail = self.rng.choice([self.digits(4), self.digits(1) + self.rng.choice("ABCDEFGHIJ") + self.digits(2)])
        got = a + self.rng.choice(["", "-", " "]) + tail
        return got.lower() if self.rng.random() < 0.1 else got

    def street_name(self) -> str:
        r, a, b = self.rng, self.rng.choice(self.surnames), self.rng.choice(self.surnames)
        date = f"{r.choice(['Dois', 'Quinze', 'Vinte', 'Primeiro'])} de {r.choice(['Maio', 'Julho', 'Setembro', 'Novembro'])}"
        return r.choice(STREET_TYPES) + " " + r.choice([f"{r.choice(_HONOURED)} {a}", f"{r.choice(_HONOURED)} {a} {b}", f"do {a}", f"da {a}", f"das {a}s", f"dos {a}s {b}s", f"{r.choice(self.given)} {a}", f"{a}", f"{a} de {b}", f"{a}-{b}", f"Nova {a}", date])

    def street(self) -> str:
        n = self.digits(self.rng.choice([2, 3, 4]))
        return self.street_name() + self.rng.choice([", ", " ", " n. ", ", nº ", " número ", ", n° "]) + n + self.rng.choice(["", "", f", apto {self.digits(2)}", f", casa {self.digits(1)}", f", bloco {self.digits(1)}", f", {self.rng.choice(['Vila', 'Jardim', 'Parque', 'Alto', 'Bairro', self.rng.choice(self.surnames)])} {self.rng.choice(self.surnames)}", f" - CEP {self.digits(5)}-{self.digits(3)}"])

    def email(self) -> str:
        r = self.rng
        local = fold(r.choice(self.given)) + r.choice(["", ".", "_", "-"]) + r.choice(["", fold(r.choice(self.surnames))]) + r.choice(["", self.digits(2), "+seguro"])
        host, end = r.choice(["mail", "posta", "servidor", "empresa", fold(self.word(2))]), r.choice(["example", "org", "net", "com.br"])
        return r.choice([f"{local}@{host}.{end}"] * 4 + [f"{local} arroba {host} ponto {end}", f"{local} (arroba) {host}.{end}", f"{local}[at]{host}.{end}", f"{local} @ {host}.{end}", f"{local} (at) {host} (ponto) {end}"])

    def other(self, slot: str) -> str:
        """A value that is no personal detail."""
        r, a, b = self.rng, self.rng.choice(self.surnames), self.rng.choice(self.surnames)
        if slot == "Firm":
            return r.choice([f"Seguradora {a}", f"{a} Seguros", f"{a} Assistência", f"Companhia {a} de Seguros", f"{a} Seguros Gerais"])
        if slot in ("Surname", "Place", "Model"):
            return {"Surname": a, "Place": r.choice([f"{r.choice(_PLACES)} {a}", f"{r.choice(_PLACES)} {a}", a, f"{a} do Sul", f"{r.choice(_PLACES)} do {a}"]), "Model": f"{a} {b}"}[slot]
        if slot == "year":
            return f"20{r.randint(10, 25)}"
        if slot == "date":
            return f"{r.randint(10, 28)}/0{r.randint(1, 9)}/20{r.randint(10, 25)}"
        if slot == "cnpj":
            return f"{self.digits(2)}.{self.digits(3)}.{self.digits(3)}/0001-{self.digits(2)}"
        if slot == "process":
            return f"{self.digits(5)}.{self.digits(6)}/20{r.randint(10, 25)}-{self.digits(2)}"
        return self.digits(int(re.sub(r"\D", "", slot)))


@functools.lru_cache(maxsize=500_000)
def fold(text: str) -> str:
    """Lower case without accents; one character for one."""
    if text.isascii():
        return text.lower()
    out = []
    for c in text:
        bare = unicodedata.normalize("NFD", c.lower())
        out.append(bare[0] if bare else c)
    return "".join(out)


def _typo(rng: random.Random, text: str) -> str:
    at = [i for i in range(1, len(text) - 2) if text[i].isalpha() and text[i + 1].isalpha() and text[i - 1].isalpha()]
    if not at:
        return text
    i = rng.choice(at)
    return text[:i] + text[i + 1] + text[i] + text[i + 2 :]


def carrier(rng: random.Random, rule: str, held_out: bool = False) -> str:
    """A sentence of a rule in which only value slots are open."""
    line = f"<{rule}>"
    while "<" in line:
        line = re.sub(r"<(\w+)>", lambda m: rng.choice(alternatives(m.group(1), held_out)), line, count=1)
    line = re.sub(r"\{number\}", lambda m: rng.choice(RULES["number"]), line)
    return line[0].upper() + line[1:]


def training_texts(n: int, seed: int = 11, held_out: bool = False) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], set[str]]:
    """n texts with their details as (start, end, type), and the folded words that are proper names."""
    rng = random.Random(seed)
    values = Values(rng)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(3, 7)):
            line = carrier(rng, rng.choice(MARKED if rng.random() < 0.55 else UNMARKED), held_out)
            if rng.random() < 0.3:
                slot = line.find("{")
                head = line if slot < 0 else line[:slot]
                line = _typo(rng, head) + line[len(head) :]
            piece, at = "", 0
            while at < len(line):
                if line[at] != "{":
                    piece += line[at]
                    at += 1
                    continue
                stop = line.index("}", at)
                slot, at = line[at + 1 : stop], stop + 1
                lead, kind = "", None
                if slot in ("name", "phone", "plate", "street", "email"):
                    value = getattr(values, slot)()
                    kind = {"name": "person_name", "street": "street_address"}.get(slot, slot)
                elif slot in ("id", "id_bare"):
                    lead, value = values.id_value()
                    lead, kind = lead if slot == "id" else "", "identity_number"
                elif slot == "fullname":
                    value = values.name(True)
                elif slot == "streetname":
                    value = values.street_name()
                else:
                    value = values.other(slot)
                piece += lead
                if kind:
                    value = value.rstrip(".") if line[at : at + 1] == "." and kind == "person_name" else value
                    spans.append((len(text) + len(piece), len(text) + len(piece) + len(value), kind))
                piece += value
            if rng.random() < 0.2:  # lines broken after a full stop, also that of an abbreviation
                piece = piece.replace(". ", ".\n")
            text += piece + (" " if rng.random() < 0.85 else "\n")
        how = rng.random()
        if how < 0.14:
            text = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        elif how < 0.24:
            text = "".join(c.upper() if len(c.upper()) == 1 else c for c in text)
        elif how < 0.36:
            text = "".join(unicodedata.normalize("NFD", c)[0] for c in text)
        out.append((text, spans))
    return out, values.proper
