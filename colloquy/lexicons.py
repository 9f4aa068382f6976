"""Word lists and patterns used as default parameters.

Every operator that matches words takes its list as a parameter; the values
here are only the defaults.  Lists are plain words; ``any_of`` turns one into a
case-insensitive pattern.
"""

from __future__ import annotations


def any_of(words: list[str]) -> str:
    """Pattern that matches any of the given words or sub-patterns."""
    return "(?iu)(?:" + "|".join(words) + ")"


# ---------------------------------------------------------------------------
# Fixed values.  These must equal the chat formats and word lists that results
# are compared against, so they are kept together and in plain order.
# ---------------------------------------------------------------------------

# Marks of announcements, notices and media placeholders in chat exports.
GROUP_SELF = "我是群聊"
ANNOUNCEMENT_STARTS = ["群公告", "群规", "群主", "本群", "欢迎加入", "欢迎新成员"]
ANNOUNCEMENT_LABELS = [
    "我是群聊", "群公告", "群规", "群主提醒", "群主", "系统通知", "系统消息",
    "欢迎加入群聊", "本群须知", "公告",
]
ANNOUNCEMENT_LINE_LABELS = ["我是群聊", "群公告", "群规", "群主提醒", "本群须知", "系统通知", "系统消息"]
POLLUTION_LABELS = ["群公告", "群规", "群主提醒", "本群须知", "系统通知", "系统消息"]
POLLUTION_STARTS = ["系统通知", "系统消息", "群主提醒", "本群须知", "公告"]
NOTICES = [
    "撤回了一条消息", "你撤回了一条消息",
    "加入了群聊", "移出了群聊", "移出群聊", "退出群聊", "退出群", "邀请.*加入了群聊", "扫描.*二维码加入群聊",
    "拍了拍", "对方正在输入",
    "你已添加了.*现在可以开始聊天了", "以上是打招呼内容", "开启了朋友验证",
    r"\[(?:通话时长\s*\d{1,2}:\d{1,2}|语音通话|视频通话)\]",
    r"\[(?:微信红包|红包|转账|群收款)\]",
    "收到红包", "发出红包", "领取了红包",
    "joined the group", "left the group", "pinned a message", "changed the group name",
]
SYSTEM_SENDER_STARTS = [
    "群聊", "群公告", "群规", "群主", "系统通知", "系统消息", "本群", "公告",
    "管理员", "系统", "机器人", "提醒助手",
]
SYSTEM_SENDER_NAMES = [
    "system", "admin", "bot", "notice", "notification", "service", "wechat", "telegram",
]
# Media tokens by type; the order decides which type a mixed text gets.
MEDIA_TOKENS = {
    "image": ["图片", "image", "photo"],
    "sticker": ["表情包", "动画表情", "动画贴图", "贴图", "sticker"],
    "voice": ["语音", "voice", "audio"],
    "video": ["视频", "video"],
    "file": ["文件", "file"],
    "location": ["位置", "location"],
}
OTHER_MEDIA_TOKENS = ["名片", "contact", r"通话时长[^\s\]]*", "红包", "微信红包", "转账", "群收款"]
WEEKDAYS = [
    "星期[一二三四五六日天]", "周[一二三四五六日]",
    "Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday",
]

# Vocabulary filter.
MEDIA_WORDS = [
    "图片", "照片", "语音", "视频", "表情包", "动画表情", "动画贴图", "贴图", "文件", "位置", "名片",
    "image", "photo", "video", "voice", "audio", "sticker", "file",
]
SYSTEM_WORDS = [
    "我是群聊", "群聊", "群公告", "群规", "群主", "本群", "系统", "通知", "消息", "公告", "撤回", "打招呼",
]
STOPWORDS = [
    "这个", "那个", "什么", "怎么", "不是", "因为", "所以", "但是", "我们", "你们", "他们",
    "自己", "一个", "一下", "还是", "觉得", "可以", "没有", "现在", "知道", "这样", "那样",
    "如果", "为了", "而且", "或者", "可能", "应该", "已经", "图片", "照片", "文字", "消息",
    "群聊", "公告", "的话", "然后", "不过", "只是", "其实", "特别", "非常", "比较",
]
PARTICLES = ["啊", "呀", "呢", "嘛", "吧", "诶", "欸", "啦", "哦", "嗷", "唔"]

# Habit phrases, openers and closers.
PHRASES = {
    "assent": "好(?:呀|的|吧|呗|嘛|嘞|哇|滴)|收到",
    "reassure": "没事(?:儿|呀|啦)?|没关系|不客气(?:啦)?|懂了就好",
    "greet": "晚安(?:安)?|早(?:呀|安|上好)?|明天见|先去忙啦|拜拜(?:啦)?|去睡啦",
    "confirm": "确实|真(?:的|滴)|对(?:呀|的|滴|啊)|没问题|行(?:呀|的|啊|嘞)|妥妥|ok",
    "laugh": "哈哈哈+|哈哈|2333+|笑死|笑出声|太逗了|太搞笑了|hh+",
    "exclaim": "救命|绝了|神了|我天|离谱|尊嘟假嘟|我的妈|真的假的|天哪|好家伙",
    "permit": "可以(?:呀|啊|可以)|行行行|好好好|也是",
    "ask": "怎么啦|怎么了|在哪呢|在干嘛|干嘛呢",
}
OPENINGS = [
    "早", "早安", "早呀", "早上好", "哈喽", "哈罗", "嗨", "hi", "hello", "hey", "在吗", "在嘛", "在不",
    "在呢吗", "晚上好", "中午好", "下课了", "刚下课", "刚到家", "到家了", "刚醒", "醒了", "你醒啦", "出来",
    "在干嘛", "干嘛呢", "你在干嘛", "吃了吗", "吃饭没", "跟你说", "跟你讲", "看这个",
]
CLOSINGS = [
    "晚安", "好梦", "早点睡", "早点休息", "去睡了", "睡了", "先睡了", "明天聊", "明天见", "拜拜", "byebye",
    "bye", "退了", "撤了", "等下聊", "一会儿聊", "待会聊",
]

# Context markers.
MARKERS = {
    "humor": ["哈哈", "233", "逗你", "开玩笑", "笑死", "好玩", "逗比", "lol", "haha"],
    "serious": ["重要", "必须", "严肃", "工作", "考试", "生病", "真的", "严谨"],
    "sadness": ["难过", "伤心", "哭", "委屈", "抑郁", "烦", "累死", "心碎", "惨"],
    "uncertainty": ["不知道", "确定吗", "是不是", "可能", "也许", "大概", "怎么", "为啥", "如何"],
    "greeting": ["在嘛", "在吗", "早", "早上好", "晚安", "嗨", "哈喽", "hello", "hi"],
    "explanation": ["为什么", "怎么回事", "原因", "详细", "解释", "具体"],
    "closing": ["先睡了", "下了", "拜拜", "改天聊", "再见", "晚安", "去忙了"],
}

# Emoji context tags; a rule may give two tags.
EMOJI_TAGS = [
    (["joking"], ["哈哈", "233", "逗", "笑死", "笑出声", "好玩", "逗比", "lol", "haha", "xd", "😂", "🤣"]),
    (["teasing", "teasing_banter"],
     ["笨蛋", "才不", "哼", "明明", "略略略", "傲娇", "😏", "调侃", "捉弄", "逗你"]),
    (["affection"],
     ["爱", "喜欢", "抱抱", "亲亲", "比心", "想你", "暖心", "好棒", "心疼", "🥰", "😍", "❤️"]),
    (["agreement"],
     ["好呀", "好的呀", "好嘞", "没问题", "同意", "赞成", "行呀", "走起", "妥妥", "ok", "👍", "确实", "好的",
      "收到"]),
    (["thinking"], ["想想", "琢磨", "好奇", "思考", "分析", "为什么", "为啥", "🤔"]),
    (["tired_night", "tired_sleep"],
     ["困", "睡了", "晚安", "累死", "撑不住", "好累", "睡觉", "休息", "歇歇", "😴", "🥱", "夜深"]),
    (["pleading_cute"],
     ["好不好", "求求", "拜托", "好嘛", "可以嘛", "帮帮", "帮我", "求你", "🥺", "QAQ", "qwq"]),
    (["celebration"],
     ["太棒了", "冲", "恭喜", "稳了", "牛哇", "厉害", "干得漂亮", "庆祝", "🎉", "👏", "🍻"]),
    (["sadness"], ["难过", "伤心", "哭了", "呜呜", "委屈", "破防", "心碎", "惨", "哭死", "😭", "😢"]),
    (["frustration"],
     ["气死", "烦", "讨厌", "无语", "暴躁", "抓狂", "崩溃", "服了", "离谱", "😡", "🤬"]),
    (["greeting_closing"],
     ["早呀", "早上好", "哈喽", "嗨", "hi", "hello", "拜拜啦", "回头见", "改天聊", "在吗", "在嘛"]),
]
NON_EMOJI = ["®", "©", "™", "〰", "〽", "ℹ", "Ⓜ", "㊗", "㊙", "🅿"]

# Exemplar phases, first match wins.
PHASES = {
    "banter": ["哈哈", "233", "逗", "笑死", "太搞笑了", "笨蛋", "才不", "略略", "怎么可能", "哪有"],
    "agreement": ["好(?:呀|的|吧|嘞)", "收到", "确实", "对(?:呀|的)", "行(?:呀|啊)", "没问题", "妥妥"],
    "greeting": ["早(?:呀|安)?", "晚安", "在吗", "在嘛", "哈喽", "嗨", "hi", "hello", "明天见", "拜拜"],
    "affection": ["爱", "喜欢", "想你", "抱抱", "亲亲", "心疼", "辛苦啦", "暖心", "🥰", "❤️"],
}

# Facts, notes and timeline words.
FACT_CATEGORIES = {
    "school": ["学校", "实验", "实验中学", "大学", "高中", "初中", "同校", "学妹", "学长", "同班", "上课",
               "下课", "入学", "年级"],
    "location": ["河南", "郑州", "金水", "北京", "上海", "图书馆", "食堂", "宿舍", "操场", "教室", "自习室"],
    "hobby": ["引体向上", "破纪录", "体测", "喜欢", "爱吃", "听歌", "打游戏", "看电影", "跑步", "健身", "运动"],
    "emotion": ["开心", "难过", "生气", "烦", "好累", "想哭", "太棒了", "哈哈"],
}
NOTE_LOCATION = ["学校", "地区", "国家", "World", "Environment", "地点", "校区"]
NOTE_RELATION_KEYS = ["关系", "加", "认识"]
NOTE_RELATION_SECTIONS = ["关系"]
NOTE_TIMELINE = ["时间", "认识", "事件", "入学", "体测"]

# Reply scoring.
SITUATIONS = {
    "teasing": ["哈哈", "233", "逗你", "开玩笑", "笑死", "好玩", "逗比", "lol", "haha", "调侃"],
    "emotional": ["难过", "伤心", "哭", "委屈", "抑郁", "烦", "累死", "心碎", "难受", "惨", "痛苦", "好累"],
    "inquiry": ["吗", "呢", "啥", "什么", "怎么", "如何", "为什么", "在哪", "多少", "谁", r"\?", "？"],
    "formal": ["请问", "贵方", "合作", "报告", "会议", "祝好", "您"],
}
BEHAVIOR = {
    "playful": ["哈哈", "哼", "才不", "明明", "你才是", "略略略", "好呀", "偏不", "笑死", "好玩", "诶嘿", "233"],
    "gentle": ["抱抱", "摸摸", "辛苦啦", "别难过", "没事", "我在", "慢慢来", "乖", "好啦", "别急", "休息"],
    "formal": ["您", "您好", "请问", "不知道是否", "非常抱歉", "很高兴为您", "祝您"],
}
IDENTITY_LEAK = ["作为AI", "人工智能", "语言模型", "我很抱歉听到", "希望对你有帮助"]
DIRECT_QUESTION = ["吗", "呢", "啥", "什么", "怎么", "如何", "为什么", "在哪", r"\?", "？"]
PUNCTUATION = ["。", "，", "？", "！", "…", "、", ".", ",", "?", "!", "~", "～"]

# Memory facts: ordered prefixes with category and key.
FACT_PREFIXES = [
    ("最喜欢", "preference", "favorite"),
    ("喜欢", "preference", "likes"),
    ("讨厌", "preference", "dislikes"),
    ("我住在", "profile", "location"),
    ("在", "profile", "location"),
    ("我是", "profile", "identity"),
    ("我叫", "profile", "name"),
]
FACT_SEPARATORS = "，,。！!~\n"
RECALL_WORDS = {"value": ["撤回", "recall", "withdraw"], "key": ["recall", "withdraw"]}

# Live messages.
COMMANDS = r"^/(?:start(?:\z|[ @])|status|pair)"
INTENTS = {
    "apology": ["对不起", "抱歉", "我错了", "不好意思", "是我不好", "别生气", "原谅我", "sorry", "my bad"],
    "crisis": ["为什么离开我", "为什么要离开我", "离开我", "我做错啥了", "我做错什么了", "丢下我", "不要走",
               "别走", "避开我", "躲着我", "绕着我走"],
    "demand": ["难道不应该", "为什么不跟我打招呼", "不该跟我打招呼", "每天跟我打招呼", "天天打招呼",
               "每天打招呼", "查岗", "必须打招呼"],
    "confession": ["喜欢你", "爱你", "做我女朋友", "在一起吧", "想你了", "我想你"],
    "complaint": ["怎么不理我", "又不理我", "你人呢", "去哪了", "回这么慢", "烦人", "讨厌", "无语", "生气"],
    "provocation": ["你滚", "有病", "傻逼", "闭嘴", "烦死了", "受够了", "懒得理你", "分手", "别说了"],
    "affection": ["想你", "宝", "好可怜", "乖", "早安", "晚安", "抱抱", "摸摸"],
    "question": [r"[?？]\z", "吗", "什么", "怎么"],
    "tease": ["哈哈", "233", "笑死", "笨蛋"],
    "sincere": ["真的", "非常", "十分"],
    "attachment": ["理我", "去哪"],
}
INTERROGATIVES = [
    "吗", "嘛", "呢", "啥", "什么", "怎么", "怎样", "如何", "哪里", "哪儿", "哪个", "哪家", "几点",
    "为什么", "多少", "谁", "是不是", "能不能", "要不要", "行不行", "有没有", "会不会", "可不可以", "好不好",
]
QUESTION_STARTS = [
    "what", "why", "where", "when", "who", "which", "how", "is", "are", "can", "could", "would", "will",
    "do", "does", "did",
]
ANSWER_STOPWORDS = [
    "吗", "嘛", "呢", "吧", "呀", "啊", "啥", "什么", "怎么", "怎样", "如何", "哪里", "哪儿", "哪个", "哪家",
    "什么时候", "为什么", "为啥", "是不是", "能不能", "要不要", "行不行", "有没有", "会不会", "可不可以",
    "好不好", "你", "我", "他", "她", "它", "的", "了",
    "what", "why", "where", "when", "who", "which", "how", "is", "are", "the", "a", "an", "to", "do",
    "does", "did", "can", "could", "would",
]
ANSWER_PUNCTUATION = "?？!！。，,.~… \t\n\r/\\-+="

# Reply cleaning.
SPEAKER_LABELS = [
    "User", "用户", "Human", "Counterpart", "AI", "Assistant", "助手", "小助手", "Bot", "System", "系统",
]
ANSWER_LABELS = ["回复", "答", "说"]
USER_LINE = r"(?i)^(?:user|用户|human|counterpart)[:：\s]"
QUOTE_PAIRS = ['""', "''", "“”", "‘’", "「」", "『』"]
REPLY_FIELDS = [
    "candidate_a", "final_message", "reply", "message", "content", "response", "text", "candidate_b",
    "candidate_c",
]
REPLY_ARTIFACTS = [
    "^(?:群公告|群规|群主提醒|系统通知|系统消息|欢迎加入|本群须知|公告[：:])",
    "我是群聊", "撤回了一条消息", "拍了拍", "移出了群聊", "加入了群聊", "开启了朋友验证", "现在可以开始聊天了",
    "joined the group", "left the group", "pinned a message",
    r"^\[(?:图片|image|表情包|动画表情|语音|视频|文件)\]\z",
    "在呢，怎么啦~", "在忙呢，稍等下哦",
]
AI_MARKERS = [
    "作为ai", "作为一名ai", "作为一个ai", "作为一个人工智能", "作为人工智能", "作为一个语言模型",
    "作为一个大型语言模型", "作为大型语言模型", "作为一个大语言模型", "作为大语言模型", "作为语言模型",
    "作为虚拟助手", "作为ai助手", "我是ai", "我是一个ai", "我是人工智能", "我是由openai训练", "as an ai",
    "i'm an ai", "i am an ai", "有什么可以帮您", "有什么我可以帮您", "很高兴为您服务", "请问有什么可以协助",
    "我能为您做些什么", "请告诉我您的需求", "为您解答", "opencode",
]
