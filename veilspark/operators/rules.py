"""The detection rules, as data. Patterns are fixed values of the formats they find."""

from __future__ import annotations

from typing import NamedTuple

from veilspark.functions.text import SPACE

S = f"[{SPACE}]*"
D = r"\p{Nd}"
NUM = rf"{D}+(?:\.{D}+)?"
_WORD = r"\p{L}\p{N}_"


class Rule(NamedTuple):
    name: str
    kind: str
    prefix: str
    strategy: str
    core: str
    #: label: the value after a label; word: stands alone, of word characters; edge: stands alone, of other characters too; free.
    sort: str
    flags: str = ""
    #: A cheaper pattern without which no text has a value; most texts end there.
    sign: str = ""

    @property
    def java(self) -> str:
        """For Spark: group 1 is the value. The separator before a value is consumed, the one after it is not."""
        body = f"({self.core})" if self.sort != "label" else self.core
        flags = f"(?{self.flags}u)" if self.flags else ""
        if self.sort in ("word", "edge"):
            return f"{flags}(?:^|[^{_WORD}]){body}(?![{_WORD}])"
        return flags + body


#: Words that a rule for whole words can match at all: none is shorter.
WORDS = rf"[{_WORD}]{{8,}}"

_YEAR_DATE = r"(?:18|19|20)" + D + "{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]" + D + "|3[01])"
_PROVINCES = "北京市 天津市 上海市 重庆市 河北省 山西省 辽宁省 吉林省 黑龙江省 江苏省 浙江省 安徽省 福建省 江西省 山东省 河南省 湖北省 湖南省 广东省 海南省 四川省 贵州省 云南省 陕西省 甘肃省 青海省 台湾省 内蒙古自治区 广西壮族自治区 西藏自治区 宁夏回族自治区 新疆维吾尔自治区 香港特别行政区 澳门特别行政区".split()
_CREDIT = "[0-9A-HJ-NP-RTUW-Y]"

RULES = [
    Rule("label_project", "project_name", "项目", "pseudonym", rf"项目名称[:：]{S}([^。；;，,\n|]+)", "label"),
    Rule("label_organization", "organization", "单位", "pseudonym", rf"(?:承担单位|项目单位|合作单位|应用单位)[:：]{S}([^。；;，,\n|]+)", "label"),
    Rule("label_person", "person", "人员", "pseudonym", rf"(?:联系人|负责人|项目负责人|经办人)[:：]{S}([一-龥]{{2,4}})", "label"),
    Rule("label_amount", "amount", "金额区间", "range", rf"(?:Amount|Budget|Cost|Revenue|金额|合同金额|预算|收益)[:：]{S}(\$?{S}{NUM}{S}(?:亿元|万元|元|USD|RMB|CNY|dollars?)?)", "label", "i"),
    Rule("id_card", "id_card", "身份证", "mask", rf"[1-9]{D}{{5}}{_YEAR_DATE}{D}{{3}}[{D}Xx]", "word"),
    Rule("bank_card", "bank_card", "银行卡", "mask", rf"4[0-9]{{12,18}}|5[1-5][0-9]{{14,17}}|3[47][0-9]{{13}}|3[068][0-9]{{12}}|6(?:011|5[0-9]{{2}})[0-9]{{12,15}}|62[0-9]{{14,17}}|(?:2131|1800|35{D}{{3}}){D}{{11}}", "word"),
    Rule("passport", "passport", "护照", "mask", rf"[GEDSMPFT]{D}{{7,8}}", "word", "i"),
    Rule("credit_code", "unified_social_credit_code", "信用代码", "pseudonym", rf"{_CREDIT}{{2}}{D}{{6}}{_CREDIT}{{10}}", "word", "i"),
    Rule("address", "address", "地址", "mask", rf"(?:{'|'.join(_PROVINCES)})[一-龥A-Za-z0-9（）()\-]{{2,60}}(?:路|街|道|巷|号|室|楼|层|村|镇|区|县|市)", "free", sign="省|(?:北京|天津|上海|重庆)市|自治区|特别行政区"),
    Rule("contract_id", "contract_id", "合同编号", "pseudonym", rf"HT-{D}{{4}}-{D}{{3,}}", "edge", "i", "(?i)HT-"),
    Rule("phone", "phone", "电话", "mask", rf"1[3-9]{D}{{9}}", "word"),
    Rule("email", "email", "邮箱", "mask", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "free", sign="@"),
    Rule("patent_id", "patent_id", "专利", "pseudonym", rf"(?:ZL|CN){D}{{9,13}}(?:\.{D})?", "edge", "i", rf"(?i)(?:ZL|CN){D}"),
    Rule("software_copyright", "software_copyright", "软著", "pseudonym", rf"{D}{{4}}SR{D}{{5,8}}", "word", "i"),
    Rule("amount", "amount", "金额区间", "range", rf"(?<![A-Za-z0-9]){NUM}{S}(?:亿元|万元|元)", "free", sign="元"),
    Rule("technical_metric", "technical_metric", "技术指标", "keep", rf"(?:≤|>=|≥|<=)?{S}{NUM}{S}(?:kV|KV|%|％|次|天|小时|h|MW|kW|MWh|kWh)", "free"),
    Rule("validation_evidence", "validation_evidence", "验证信息", "keep", r"(?:试运行|现场验证|示范应用|第三方检测|验收结论)[^。；;\n]{0,30}", "free"),
]

TECHNICAL_SIGNAL = rf"kV|KV|误差|精度|试运行|试验|验证|达标|样机|现场|≤|>=|%|％|{D}+{S}天"

DICTIONARY_PREFIX = {"organization": "单位", "project_name": "项目", "person": "人员", "technical_term": "技术要素"}

#: kind -> (domain, level) of what redacting it costs an assessment.
IMPACT = {
    "technical_metric": ("trl", "high"), "validation_evidence": ("trl", "high"), "amount": ("benefit", "high"), "patent_id": ("evidence", "medium"),
    "software_copyright": ("evidence", "medium"), "organization": ("transfer_readiness", "medium"), "project_name": ("context", "low"),
    "contract_id": ("traceability", "low"), "person": ("privacy", "none"), "phone": ("privacy", "none"), "email": ("privacy", "none"),
}
LEVELS = ["none", "low", "medium", "high"]
STRATEGIES = ["pseudonym", "mask", "range", "keep"]
#: Kinds that a pseudonym keeps harmless.
SOFTENED = ["patent_id", "software_copyright", "organization", "project_name", "contract_id"]
