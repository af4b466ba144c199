"""Fixed values of the interview lexicon: patterns, cue words, topics and spellings.

These decide results and must stay as they are; everything that applies them is elsewhere.
"""

# Patterns over a segment's text.
QUESTION_MARK = r"[？?]"
QUESTION_WORD = (
    r"为什么|怎么(?:做|处理|实现|看)?|如何|什么|哪(?:些|个|里)|多少|是否|有没有|能不能|"
    r"可不可以|介绍(?:一下)?|讲(?:一下|一讲|讲)?|说(?:一下|说)|请你|复杂度|区别|原理|"
    r"你会|你觉得|你认为|对吗|是吗|呢[？?]?"
)
QUESTION_START = r"^(那|那么|所以|请|你|能|可以|为什么|怎么|如何|什么|哪(?!怕)|介绍|讲一下|讲讲|说一下|说说|复杂度)"
QUESTION_END = r"(吗|么|呢|为什么|怎么|如何|什么)[，。！？?]*$"
INTERVIEWER_CONTROL = r"下一个问题|换一个问题|再问一个|接下来(?:问|聊|看)|我想问|(?:我)?有(?:几|个).*问题|请你|你先|展开讲|具体讲|能讲|能说|说说|介绍一下"
CANDIDATE_EVIDENCE = (
    r"我(?:负责|参与|做了|做的|设计|实现|优化|搭建|当时|会先|的思路|认为)|我们(?:当时|项目|团队|会|把)|我的(?:工作|项目|思路|方案)|"
    r"首先我|然后我|当时我|具体来说|原因是|主要是"
)
ACKNOWLEDGEMENT = r"^(嗯+|啊+|哦+|好(?:的)?|可以|明白|行|对+|是的|OK|ok)[，。！？、\s]*$"
ACKNOWLEDGEMENTS = ("嗯", "好", "好的", "可以", "明白", "行", "对", "继续")
AFFIRMATIVE_START = r"^(好的|好|是的|对|嗯|首先|我觉得|我的思路|当时|因为)"
DIRECT_ADDRESS = (
    r"那你|那如果|我想问|你刚才|刚才你|刚刚.*(?:提到|说)|你们会|会不会|能详细|请你|介绍一下|讲一讲|讲一下|说一下|复杂度呢|^为什么|"
    r"你.*(?:为什么|怎么|如何)|(?:区别|优劣|流程|原理|转移方程).*是什么|(?:区)?别是什么|优劣是.?什么|转移方程.*为什么|那在.*是不是|是不是也有|"
    r"是什么呢|项目.*部署|那最后.*项目|那.*(?:decoder only|内存|显存)|出现.*(?:case|错误|偏离).*(?:需要|处理|解决)|需要.*(?:处理|解决).*还[，。！？?]*$"
)
FOLLOW_UP = r"^(那|那么|所以|具体|为什么|怎么|如果|刚才|进一步|还有|继续|这个|然后呢|复杂度)|你刚才|刚刚提到|展开(?:讲|说)|细说|什么意思"
CLARIFICATION = r"什么意思|你是说|也就是说|换句话说|没听清|再说一遍|确认一下|我理解的是|能看到吗|能听到吗"
NEW_TOPIC = r"下一个问题|换一个问题|再问一个|接下来|另外一个方向|最后一个问题|再聊(?:一下)?|下面问"
ADMIN = r"能听到|听得到|摄像头|麦克风|共享屏幕|屏幕共享|网络问题|刷新(?:一下)?|编辑器加载|会议.*重启|看得到吗|能看到吗|能看见|看得见"
INVITATION = r"你还有什么.*(?:想问|问题)|你有没有什么.*问题|你这边有什么.*问题|我这边.*没有什么.*(?:问题|你)|还有什么想了解"
NO_MORE_QUESTIONS = r"(?:我)?(?:这)?边(?:没|没有)什么(?:问题)?"
PROMPT_MARKER = r"那你|那如果|那这个|我想问|你刚才|刚才你|你们会|会不会|能详细|能否|能不能|请你|介绍一下|讲一讲|讲一下|说一下|复杂度呢|为什么|是怎么|是什么样|怎么样去"
PRECISE_MARKER = r"那你|那如果|我想问|你刚才|刚才你|你们会|会不会|能详细|能否|能不能|请你|介绍一下|讲一讲|讲一下|说一下|复杂度呢"
RESPONSE_START = r"^(好的|好|是的|对|嗯|你好|我叫|我(?:当时|负责|参与|做|会|先|的)|我们|首先|因为|可以用|我的)"
EXAMPLE_CUE = r"比如(?:说)?|例如|举个例子"
IMPERATIVE_START = r"^(请|介绍|说说|讲讲)"
PROJECT = r"项目|实习|经历|负责|业务|公司|团队|工作里|工作中|做的.*(?:系统|平台|Agent|agent)"
PROJECT_PROMPT = r"展开.*(?:经历|项目)|讲讲.*(?:项目|经历)|介绍.*(?:项目|经历)|你在.*(?:负责|做)|具体负责|挑战.*地方"
PROJECT_ADDRESSED = r"你.*(?:项目|实习|经历|负责|做|迭代)|(?:项目|实习|经历).*你"
CODING_STRONG = (
    r"开始(?:做|写).*题|看一下题目|先看题目|编辑器|编译器|在线编程|代码的话.*(?:Python|Java|C\+?\+?|Go)|共享屏幕.*(?:题|代码)|"
    r"写一下代码|实现一下|给定一个|输入.*(?:数组|字符串)|输出.*(?:数组|结果)"
)
CODING_DISCUSSION = r"思路|复杂度|为什么|边界|优化|正确性|怎么想|解释一下|讲一下|这题|算法"
TECH = r"Redis|MySQL|HTTP|TCP|DPO|SFT|RAG|Transformer|Python|Java|GC|MVCC|哈希|进程|线程|数据库|索引|网络|模型|算法"
BEHAVIORAL = r"最大的困难|遇到.*冲突|团队合作|如何沟通|为什么离职|优点|缺点|职业规划|失败的经历"
CANDIDATE_QUESTION_START = r"我想问(?:一下)?.*(?:岗位|团队|业务|工作|方向|场景)|关于.*岗位.*(?:想问|了解)|岗位.*具体.*(?:做|负责)|团队.*具体.*(?:方向|业务)"
CANDIDATE_QUESTION_CUE = r"我想问(?:一下)?"
CANDIDATE_QUESTION_TOPIC = r"岗位|团队|业务|工作内容|这个组|方向|场景"
END = r"今天面试先到|面试.*(?:结束|到这里)|拜拜|谢谢你.*拜|那今天就这样"
V1_QUESTION = r"(什么|为什么|怎么|如何|哪些|区别|原理|介绍一下|说一下|讲一下|能否|可不可以|有没有|是否|请你|你会)"
V1_FOLLOW_UPS = ("那", "那么", "继续", "具体", "为什么", "如果", "刚才", "进一步", "还有", "追问")
V1_NEW_TOPICS = ("下一个问题", "换一个问题", "再问一个", "接下来", "另外一个方向", "最后一个问题")
REPEATED_CHARACTER = r"([^\s，。！？、,.!?])\1{4,}"
MEANINGFUL = r"[A-Za-z0-9一-鿿]"

# Personal data, in the order of redaction.
PERSONAL = [
    ("credential", r"(?i)\b(api[_-]?key|access[_-]?token|password|passwd|secret)\b\s*[:=]\s*[^\s,;]+"),
    ("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("phone", r"(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d{9}(?!\d)"),
    ("cn_id", r"(?<!\d)\d{17}[0-9Xx](?!\d)"),
    ("ipv4", r"(?<!\d)(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d)"),
]

# Topic dictionary, labels and words in order.
UNCLASSIFIED = "未分类"
TOPICS = {
    "数据库与缓存": ["Redis", "MySQL", "PostgreSQL", "MongoDB", "RDB", "AOF", "MVCC", "索引", "事务", "缓存", "B+ 树"],
    "分布式系统": ["Kafka", "Raft", "分布式", "一致性", "CAP", "RPC", "gRPC", "消息队列"],
    "网络": ["HTTP", "HTTPS", "TCP", "UDP", "网络", "长连接"],
    "操作系统与并发": ["Linux", "线程", "进程", "协程", "并发", "锁", "内存"],
    "编程语言与运行时": ["Python", "Java", "Go", "C++", "JVM", "GC", "垃圾回收"],
    "云原生": ["Docker", "Kubernetes", "容器", "微服务"],
    "机器学习与大模型": ["PyTorch", "Transformer", "RAG", "向量数据库", "大模型", "训练", "推理"],
}

# Spellings that recognisers get wrong.
REPLACEMENTS = {
    "redis": "Redis", "red is": "Redis", "瑞迪斯": "Redis", "mysql": "MySQL", "my sql": "MySQL", "postgresql": "PostgreSQL", "postgres": "PostgreSQL",
    "mongodb": "MongoDB", "mongo db": "MongoDB", "kafka": "Kafka", "kubernetes": "Kubernetes", "k8s": "Kubernetes", "docker": "Docker", "python": "Python",
    "java": "Java", "golang": "Go", "grpc": "gRPC", "http": "HTTP", "https": "HTTPS", "tcp": "TCP", "udp": "UDP", "rpc": "RPC", "jvm": "JVM", "aof": "AOF",
    "rdb": "RDB", "mvcc": "MVCC", "raft": "Raft", "pytorch": "PyTorch", "transformer": "Transformer", "rag": "RAG", "b+树": "B+ 树", "b 加树": "B+ 树",
    "c plus plus": "C++",
}
