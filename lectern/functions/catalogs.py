"""Catalogues: fixed values that rules and detectors read, and their rows as small frames."""

from __future__ import annotations

#: Preferred translations of terms.
PREFERRED_TERMS = {
    "质量管理体系": "Quality Management System",
    "质量手册": "Quality Manual",
    "管理者代表": "Management Representative",
    "文件控制": "Control of Documents",
    "记录控制": "Control of Records",
    "医疗器械文档": "Medical Device File",
    "设计和开发": "Design and Development",
    "风险管理": "Risk Management",
    "纠正措施": "Corrective Action",
    "预防措施": "Preventive Action",
    "不合格品": "Nonconforming Product",
    "供应商纠正措施报告": "Supplier Corrective Action Report",
    "法规符合性负责人": "Person Responsible for Regulatory Compliance",
    "法規符合性負責人": "Person Responsible for Regulatory Compliance",
    "监控和测量": "Monitoring and Measurement",
}
#: Headings and their translations.
HEADINGS = {
    "目录": "Table of Contents",
    "目的": "Purpose",
    "范围": "Scope",
    "参考文件": "References Document",
    "质量管理体系标准": "Quality Management System Specification",
    "适用法规": "Applicable Regulations",
    "定义/简写": "Definitions and Abbreviations",
    "定义简写": "Definitions and Abbreviations",
    "分发控制": "Distribution Control",
    "质量管理体系": "Quality Management System",
    "管理职责": "Management Responsibility",
    "资源管理": "Resource Management",
    "产品实现": "Product Realization",
    "测量、分析和改进": "Measurement, Analysis and Improvement",
    "测量分析和改进": "Measurement, Analysis and Improvement",
    "公司简介": "Company History",
    "更改历史记录": "History of Change",
    "文件控制": "Control of Documents",
    "记录控制": "Control of Records",
    "设计和开发": "Design and Development",
    "风险管理": "Risk Management",
    "纠正措施": "Corrective Action",
    "预防措施": "Preventive Action",
}
#: Terms of the rule checks and their recommended wording.
STANDARD_TERMS = {
    "质量管理体系": "Quality Management System",
    "质量手册": "Quality Manual",
    "管理者代表": "Management Representative",
    "文件控制": "Document Control",
    "纠正和预防措施": "Corrective and Preventive Action",
    "纠正措施": "Corrective Action",
    "预防措施": "Preventive Action",
    "不合格品": "nonconforming product",
    "医疗器械": "medical device",
    "法规要求": "regulatory requirements",
    "设计和开发": "design and development",
    "生产": "production",
    "采购": "purchasing",
    "监控和测量": "monitoring and measurement",
    "管理评审": "management review",
    "内部审核": "internal audit",
    "风险管理": "risk management",
    "顾客反馈": "customer feedback",
    "可追溯性": "traceability",
}
#: Modal words and the English ones that may stand for them.
MODALS = {
    "应": ["shall", "must", "should"],
    "必须": ["must", "shall"],
    "不得": ["shall not", "must not", "may not"],
    "可": ["may", "can"],
    "宜": ["should"],
}
STRONG_MODALS = ["应", "必须", "不得"]

#: Coverage topics (clause, title, keywords).
TOPICS = [
    ("4.1", "Quality management system - general requirements", ["质量管理体系", "Quality Management System", "process", "过程"]),
    ("4.2.3", "Medical device file", ["医疗器械文档", "Medical Device File", "MDF", "technical file"]),
    ("4.2.4", "Control of documents", ["文件控制", "Control of Documents", "Document Control", "QSP0401"]),
    ("4.2.5", "Control of records", ["记录控制", "Control of Records", "Record Control", "record", "记录"]),
    ("5.1", "Management commitment", ["管理承诺", "Management Commitment", "top management", "总经理"]),
    ("5.3", "Quality policy", ["质量方针", "Quality policy"]),
    ("5.4", "Planning and quality objectives", ["质量目标", "Quality objective", "策划", "Planning"]),
    ("5.5.1", "Responsibility and authority", ["职责", "权限", "Responsibility", "authority"]),
    ("5.5.2", "Management representative", ["管理者代表", "Management Representative", "MR"]),
    ("5.6", "Management review", ["管理评审", "Management Review", "QSP0501"]),
    ("6.2", "Human resources / competence", ["培训", "Training", "competence", "能力", "人力资源"]),
    ("6.3", "Infrastructure", ["基础设施", "Infrastructure", "设备", "Equipment"]),
    ("6.4", "Work environment and contamination control", ["工作环境", "污染控制", "Work environment", "contamination", "clean room"]),
    ("7.1", "Planning of product realization / risk management", ["产品实现", "风险管理", "Risk Management", "Planning of product realization"]),
    ("7.2", "Customer-related processes", ["客户", "顾客", "Customer", "contract review"]),
    ("7.3", "Design and development", ["设计和开发", "Design and development", "DHF", "设计开发"]),
    ("7.4", "Purchasing", ["采购", "Purchasing", "供应商", "Supplier", "SCAR"]),
    ("7.5", "Production and service provision", ["生产", "Production", "service provision", "traceability", "可追溯"]),
    ("7.6", "Monitoring and measuring equipment", ["监控和测量", "校准", "Calibration", "measuring equipment"]),
    ("8.2.1", "Feedback", ["反馈", "Feedback"]),
    ("8.2.2", "Complaint handling", ["投诉", "Complaint", "customer complaint"]),
    ("8.2.3", "Reporting to regulatory authorities", ["监管机构", "regulatory authorities", "reporting", "监管策略"]),
    ("8.2.4", "Internal audit", ["内部审核", "Internal Audit", "audit"]),
    ("8.3", "Control of nonconforming product", ["不合格品", "Nonconforming", "MRB"]),
    ("8.4", "Analysis of data", ["数据分析", "Analysis of data", "statistical"]),
    ("8.5.2", "Corrective action", ["纠正措施", "Corrective Action", "CAPA", "CPAR"]),
    ("8.5.3", "Preventive action", ["预防措施", "Preventive Action", "CPAR"]),
]

YEAR = r"[:：-]\s*((?:19|20)\d{2})\b"
_YEAR_TAIL = r"(?:\s*[:：-]\s*(?:(?:19|20)\d{2}))?\b"
_PAIR_OF_PARTS = r"\b21\s+CFR\s+(?:Parts?\s*)?(?:807\s*(?:and|&|/)\s*820|820\s*(?:and|&|/)\s*807)\b"
#: Regulations (name, kind, pattern, version pattern).
REGULATIONS = [
    ("ISO 13485", "standard", r"\b(?:(?:BS\s+EN|EN|BS)\s+)?ISO\s*[- ]?\s*13485" + _YEAR_TAIL, YEAR),
    ("ISO 14971", "standard", r"\b(?:EN\s+)?ISO\s*[- ]?\s*14971" + _YEAR_TAIL, YEAR),
    ("ISO 62366-1", "standard", r"\b(?:(?:BS\s+)?EN(?:\s+IEC)?|IEC|ISO)\s*[- ]?\s*62366\s*[-‐‑–— ]\s*1" + _YEAR_TAIL, YEAR),
    ("ISO/TR 20416", "guidance", r"\bISO\s*/?\s*TR\s*[- ]?\s*20416" + _YEAR_TAIL, YEAR),
    ("ISO 14155", "standard", r"\b(?:EN\s+)?ISO\s*[- ]?\s*14155" + _YEAR_TAIL, YEAR),
    ("EU MDR Regulation (EU) 2017/745", "regulation", r"(?:\bEU\s+MDR\s+)?Regulation\s*\(EU\)\s*(?:No\.?\s*)?2017/745\b|\bMDR\s+2017/745\b|\bEU\s+MDR\b", r"(2017/745)"),
    ("EU MDD 93/42/EEC", "regulation", r"(?:\bEU\s+MDD\s+)?(?:Directive\s*)?93/42/EEC\b|\bMDD\s+93/42/EEC\b|\bEU\s+MDD\b", r"(93/42/EEC)"),
    ("21 CFR Part 807", "regulation", _PAIR_OF_PARTS + r"|\b21\s+CFR(?:\s+Part)?\s*807(?:\.\d+)?\b", None),
    ("21 CFR Part 820", "regulation", _PAIR_OF_PARTS + r"|\b21\s+CFR(?:\s+Part)?\s*820(?:\.\d+)?\b|\bQuality System Regulations?\b|\bQSR\b", None),
    ("Canadian Medical Devices Regulations", "regulation", r"\bCanadian Medical Devices(?: Regulations?)?\b(?:\s*\(?SOR/98-282\)?)?|\bSOR/98-282\b|\bCanadian\s+MDR\b", r"(SOR/98-282)"),
    ("Canadian Medical Devices Regulations", "program", r"\bCMDCAS\b", None),
    (
        "China Medical Device Regulations",
        "regulation",
        r"医疗器械监督管理条例(?:[（(]\s*国务院令第?\s*\d+\s*号\s*[）)])?|医疗器械生产质量管理规范|\bChina Medical Devices Act\b"
        r"|\bRegulations? (?:on|for) the Supervision and Administration of Medical Devices\b(?:\s*\(State Council (?:Order|Decree) No\.?\s*\d+\))?|国务院令第?\s*\d+\s*号",
        r"(?:国务院令第?\s*|State Council (?:Order|Decree) No\.?\s*)(\d+)(?:\s*号)?",
    ),
    ("YY/T 0033", "standard", r"YY\s*/?\s*T?\s*0033" + _YEAR_TAIL + "|无菌医疗器械生产管理规范", YEAR),
    ("YY/T 0287", "standard", r"YY\s*/?\s*T?\s*0287" + _YEAR_TAIL, YEAR),
    ("YY/T 0316", "standard", r"YY\s*/?\s*T?\s*0316" + _YEAR_TAIL, YEAR),
    ("Hong Kong MDACS", "program", r"(?:\bHong Kong\s+)?\bMedical Device Administrative Control System\b(?:\s*\(MDACS\))?|\bMDACS\b|醫療儀器行政管理制度|医疗器械行政管理制度|醫療儀器的規管|医疗仪器的规管", None),
    ("Hong Kong GN guidance", "guidance", r"\bGN[-\s]?\d{1,2}(?:[-/]\d+)?\b", r"\b(GN[-\s]?\d{1,2}(?:[-/]\d+)?)\b"),
    ("MDCG guidance", "guidance", r"\bMDCG(?:\s+\d{4}[-/]\d+(?:\s+Rev\.?\s*\d+)?)?\b", r"\bMDCG\s+(\d{4}[-/]\d+(?:\s+Rev\.?\s*\d+)?)\b"),
    ("MEDDEV guidance", "guidance", r"\bMEDDEV(?:\s+\d+(?:\.\d+)?(?:/|[-‐‑–—])\d+(?:\s+rev\.?\s*\d+)?)?\b", r"\bMEDDEV\s+(\d+(?:\.\d+)?(?:/|[-‐‑–—])\d+(?:\s+rev\.?\s*\d+)?)\b"),
    ("FDA UDI/GUDID", "program", r"\b(?:FDA\s+)?(?:Unique\s+Device\s+Identification(?:\s+System)?|UDI(?:\s*/\s*GUDID)?|GUDID)\b", None),
    ("Korea Medical Devices Act", "regulation", r"\bMFDS\b.*?Medical Devices Act|\bKorea.*?Medical Devices Act", None),
]
#: Provisions that texts cite.
PROVISIONS = [
    r"\b21\s+CFR(?:\s+Part)?\s+(?:§+\s*)?\d{3}\.\d+(?:\([A-Za-z0-9]+\))*",
    r"§+\s*\d{3}\.\d+(?:\([A-Za-z0-9]+\))*",
    r"\bArticles?\s+\d+[A-Za-z]?(?:\([A-Za-z0-9]+\))*(?:\s*(?:,|and)\s*\d+[A-Za-z]?(?:\([A-Za-z0-9]+\))*)*",
    r"\bAnnex(?:es)?\s+[IVXLCDM]+(?:\s*(?:,|and)\s*[IVXLCDM]+)*\b",
    r"\bClauses?\s+\d+(?:\.\d+)*(?:\([A-Za-z0-9]+\))*(?:\s*(?:,|and)\s*\d+(?:\.\d+)*(?:\([A-Za-z0-9]+\))*)*",
]

#: Licences: the catalogue that the generated tables hold references of (name, pattern, version pattern).
LICENCES = [
    ("Apache License", r"Apache License, Version [0-9.]*[0-9]", r"Version ([0-9.]*[0-9])"),
    ("MIT License", r"MIT License", None),
    ("GNU General Public License", r"GNU General Public License, version [0-9]+", r"version ([0-9]+)"),
    ("Creative Commons BY-NC", r"CC BY-NC [0-9.]*[0-9]", r"BY-NC ([0-9.]*[0-9])"),
]
